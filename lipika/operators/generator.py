"""Synthetic documents of nine kinds from word banks, by hashes of the row number: the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from .corpus import running_cut

# The kinds and the share of each up to and with it.
KINDS = (("prose_hi", 0.17), ("prose_kn", 0.32), ("prose_en", 0.52), ("hinglish", 0.62), ("kanglish", 0.70), ("code", 0.77), ("markdown", 0.84), ("math", 0.91), ("mixed", 1.0))
# The grammar of each kind, of our own choice: sentences with places for a word of each of three banks and a number.
GRAMMAR: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "prose_hi": (("{0} ने {1} को {2} दी।", "{0} की {1} {2} के पास है।", "आज {0} और {1} {2} गए।"), ("किसान", "शिक्षक", "पड़ोसी", "डॉक्टर", "लेखक"), ("किताब", "चिट्ठी", "घड़ी", "टोकरी"), ("बाज़ार", "नदी", "स्टेशन", "मंदिर", "खेत")),
    "prose_kn": (("{0} {1} ಅನ್ನು {2} ಗೆ ಕೊಟ್ಟರು.", "{0} ಅವರ {1} {2} ಹತ್ತಿರ ಇದೆ."), ("ರೈತ", "ಶಿಕ್ಷಕ", "ವೈದ್ಯ", "ಲೇಖಕ"), ("ಪುಸ್ತಕ", "ಪತ್ರ", "ಬುಟ್ಟಿ", "ಗಡಿಯಾರ"), ("ಮಾರುಕಟ್ಟೆ", "ನದಿ", "ನಿಲ್ದಾಣ", "ಮನೆ")),
    "prose_en": (("{0} kept {1} near {2}.", "{0} sold {1} on the way to {2}.", "After {n} days {0} found {1} at {2}."), ("the clerk", "a farmer", "our teacher", "the pilot", "my neighbour"), ("a lantern", "the map", "seven letters", "an old drum"), ("the station", "the mill", "a river", "the market")),
    "hinglish": (("{0} ne {1} {2} pe rakh diya.", "kal {0} ka {1} {2} mein mila."), ("bhai", "didi", "teacher", "dost"), ("phone", "report", "chai", "ticket"), ("table", "office", "station", "ghar")),
    "kanglish": (("{0} avara {1} {2} hattira ide.", "{0} {1} annu {2} ge kotru."), ("anna", "akka", "boss", "driver"), ("file", "coffee", "laptop", "pass"), ("mane", "office", "bus stand", "angadi")),
    "code": (("def {0}_{1}({2}):\n    return {2} + {n}\n", "{0}_{1} = load({2}, {n});\n", "if {0}.{1} > {n}: {2} = None\n"), ("get", "make", "read", "drop"), ("map", "list", "node", "key"), ("x", "item", "row", "path")),
    "markdown": (("# {0} {1}\n\n* {2}: {n}\n", "**{0}** and `{1}` in [{2}](#{n})\n"), ("Setup", "Usage", "Notes", "Limits"), ("guide", "table", "query", "index"), ("first", "second", "last")),
    "math": (("$${0} = {n}{1}^2 + {2}$$", "let ${0}_{n} = {1} - {2}$ then", "\\\\({0} > {1}{2}\\\\)"), ("f", "g", "y"), ("x", "z", "t"), ("a", "b", "c")),
    "mixed": (("{0} said {1} से {2} ಗೆ {n}", "{0}: `{n}` {1} {2}"), ("Asha", "Ravi", "Meena"), ("किताब", "पानी", "घर"), ("ಮನೆ", "ನೀರು", "ಊರು")),
}
NUMBERS, SENTENCES, LEAST_WORDS = 10_000, 4, 1


def bank_sizes() -> list[tuple]:
    """(kind, sentences, words of each bank, numbers)."""
    return [(k, *(len(bank) for bank in GRAMMAR[k]), NUMBERS) for k, _ in KINDS]


def _number(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, 1 + 4 * at, 4), 16, 10).cast("long")


def documents(spark: SparkSession, words: int, seed: int, prefix: str = "syn") -> DataFrame:
    """(doc_id, kind, text): documents in order until they have ``words`` words, with the one that reaches them."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))
    share = F.conv(F.substring(F.md5(F.concat(key, F.lit(":kind"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    kind = F.lit(KINDS[-1][0])
    for name, upto in reversed(KINDS[:-1]):
        kind = F.when(F.col("share") < upto, name).otherwise(kind)

    def pick(digest: Column, bank: int, at: int) -> Column:
        out = F.lit(None).cast("string")
        for name, grammar in GRAMMAR.items():
            out = F.when(F.col("kind") == name, F.get(F.array(*map(F.lit, grammar[bank])), (_number(digest, at) % len(grammar[bank])).cast("int"))).otherwise(out)
        return out

    def sentence(k: Column) -> Column:
        digest = F.md5(F.concat(F.col("key"), F.lit(":"), k.cast("string")))
        out = pick(digest, 0, 0)
        for bank in (1, 2, 3):
            out = F.replace(out, F.lit(f"{{{bank - 1}}}"), pick(digest, bank, bank))
        return F.replace(out, F.lit("{n}"), (_number(digest, 4) % NUMBERS).cast("string"))

    rows = spark.range(words // LEAST_WORDS + 1).withColumn("key", key).withColumn("share", share).withColumn("kind", kind)
    sentences = 1 + _number(F.md5(F.concat("key", F.lit(":n"))), 0) % SENTENCES
    made = rows.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), sentences.cast("int")), sentence), " ")).withColumn("words", word_count(F.col("text")))
    cut = running_cut(made.select("id", "kind", "text", "words"), F.col("words"), words, ["id"])
    return cut.select(F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("doc_id"), "kind", "text")
