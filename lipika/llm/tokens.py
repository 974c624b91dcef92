"""Problem 1: how many tokens of an existing tokenizer each document has, and totals by source, language and domain.

The tokenizer is loaded once per worker; a batch of texts is encoded in one call. Texts don't move: only ids,
attributes and counts are shuffled, and the cube is taken over the few distinct combinations.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public split pattern of these byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The notations of languages met, and the tag each stands for.
LANGUAGES = {
    "en": "en", "eng": "en", "hi": "hi", "hin": "hi", "kn": "kn", "kan": "kn", "mr": "mr", "mul": "mul", "mixed": "mul",
    "hi-latn": "hi-Latn", "hinglish": "hi-Latn", "kn-latn": "kn-Latn", "kanglish": "kn-Latn", "zxx": "zxx", "code": "zxx", "und": "und",
}


@lru_cache(8)
def encoder(path: str):
    """A function from a list of texts to their token counts."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(x) for x in own.encode_ordinary_batch(texts, num_threads=1)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _counted(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[pa.RecordBatch]:
    count = encoder(path)
    for batch in batches:
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        whole = pa.array(count(column.filter(column.is_valid()).to_pylist()), pa.int64())
        counts = pc.replace_with_mask(pa.array([0] * len(column), pa.int64()), column.is_valid(), whole)
        rest = [k for k in range(batch.num_columns) if k != at]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), counts], names=[*(batch.schema.names[k] for k in rest), "tokens"])


def with_tokens(docs: DataFrame, path: str = DEFAULT, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` in place of the text column; null and empty texts have 0. A column called tokens before is replaced."""
    given = docs.drop("tokens")
    fields = [f for f in given.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "tokens long"])
    return given.mapInArrow(lambda it: _counted(it, path, text), schema)


def entry_form(name: Column) -> Column:
    """One spelling for an entry's name: trimmed, lower case, hyphens."""
    return F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-"))


def language_form(lang: Column) -> Column:
    """The tag of a language whatever its notation; of regional tags the language (en-IN is en); unknown ones in lower case."""
    form = F.replace(F.lower(F.trim(lang)), F.lit("_"), F.lit("-"))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(known[form], known[F.substring_index(form, "-", 1)], form)


def document_tokens(docs: DataFrame, entries: DataFrame, name: str = "name", path: str = DEFAULT) -> DataFrame:
    """(doc_id, entry, lang, kind, slot, tokens): each document once, its attributes in one notation.

    Repeated deliveries of a doc_id count once (the first loaded is kept; rows without doc_id are left out). Null
    attributes stay null. Entries outside the registry keep their name and have no slot.
    """
    given = _attributes(docs, name, "text")
    counted = with_tokens(given, path)
    once = counted.groupBy("doc_id").agg(F.min(F.struct("loaded_at", "entry", "lang", "kind", "tokens")).alias("d")).select("doc_id", "d.entry", "d.lang", "d.kind", "d.tokens")
    return once.join(_registry(entries), "entry", "left").select("doc_id", "entry", "lang", "kind", "slot", "tokens")


def described(docs: DataFrame, entries: DataFrame, name: str = "name") -> DataFrame:
    """(doc_id, entry, lang, kind, slot): document_tokens without the tokens."""
    once = _attributes(docs, name).groupBy("doc_id").agg(F.min(F.struct("loaded_at", "entry", "lang", "kind")).alias("d")).select("doc_id", "d.entry", "d.lang", "d.kind")
    return once.join(_registry(entries), "entry", "left").select("doc_id", "entry", "lang", "kind", "slot")


def _attributes(docs: DataFrame, name: str, *more: str) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", "loaded_at", entry_form(F.col(name)).alias("entry"), language_form(F.col("lang")).alias("lang"), F.regexp_replace("kind", "_held$", "").alias("kind"), *more)


def _registry(entries: DataFrame) -> DataFrame:
    return entries.where("name is not null").groupBy(entry_form(F.col("name")).alias("entry")).agg(F.min("slot").alias("slot"))


def token_budget(counted: DataFrame) -> DataFrame:
    """Documents and tokens over the cube of entry, language, kind and slot; ``level`` tells totals from null values
    (bit 3 set: over all entries, 2: languages, 1: kinds, 0: slots)."""
    cells = counted.groupBy("entry", "lang", "kind", "slot").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    return cells.cube("entry", "lang", "kind", "slot").agg(F.grouping_id().alias("level"), F.sum("n").alias("documents"), F.sum("t").alias("tokens"))
