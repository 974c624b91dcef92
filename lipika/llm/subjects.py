"""Problem 8: the subject areas of a document.

Labelling functions vote on each sentence or line; a latent model learns how accurate each of them is from the
votes of all documents, and a document has the subjects of at least a fifth of its sentences.

* lexicon: words weighted by a mixture model fitted on hand-labelled documents (labels are soft: some are wrong
  or missing); one function for clear evidence, one for weak;
* form: program text and formulas;
* section: what the heading above says, by the lexicon;
* address: words in links and paths, by the lexicon;
* source: a source whose labelled documents mostly have one subject.

Fitted on at most LABELLED documents (chosen by a hash of their id, so the same at every run); everything else
runs over all documents and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import few, materialize

LABELLED = 10_000
AREAS = 100  # subject areas; more are an error (a pattern of six votes must fit 64 bits)
SHARE = 0.2  # TESTDATA.md: at least a fifth of the sentences
LEAST_DOCS = 3  # labelled documents a word must occur in
LIFT = 2.0  # by how much the odds that a term's documents have its subject exceed the usual ones
ROUNDS, ALPHA, LABEL_TRUST = 8, 0.05, 0.98
CLEAR, WEAK = 0.9, 0.5
SOFTWARE, MATHEMATICS = "software", "mathematics"
FUNCTIONS = ("clear", "weak", "form", "section", "address", "source")

SENTENCE = re.compile(r"\n+|(?<=[^\d\s][.!?।॥])\s+|(?<=[.!?।॥][”\"')\]])\s+|(?<=\d[.!?।॥])\s+(?=[^\W\da-z_]|[“\"(\[])")
LABEL = re.compile(r"[^\W\d]+ \d+\.")  # as in: Exercise 12.
WORD = re.compile(r"[^\s\d!-@\[-`{-~।॥“”‘’—–…«»←-⯿]{2,}")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\]\(([^)\s]+)\)|[\w.+-]+@[\w-]+\.\w+")
HEADING = re.compile(r"^#{1,6}\s")
FENCE = re.compile(r"^\s*```")
FORMULA = re.compile(r"\$[^$]+\$|\\\[.*\\\]|\\\(.*\\\)|\\begin\{|^\s*\\[a-z]+\{")
CODE = re.compile(
    r"[;{}]\s*$|^\s*[})\]]+[;,]?\s*$|^\s*(?:#include|#define|#\s*\w+_\w+|//\s*\w+_\w+|/\*|\*/|--\s*\w+_\w+)|^\s*(?:def|class|import|from|return|const|let|var|export|function|if|else|elif|for|while|try|except|raise|throw|static|public|private|void|int|struct|package|func|fn|use)\b.*[=(){}:;._\[\]]"
    r"|^\s*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|FROM|WHERE|GROUP BY|ORDER BY|JOIN|LEFT JOIN|HAVING|VALUES|SET)\b|^\s*\w+(?:\.\w+)*\s*(?:[-+*/|&]?=|\+=)[^=]|\w+\([^)]*\)\s*[;{]?\s*$|\w+_\w+\[[^\]]*\]|->|=>|:="
)


def units(text: str) -> list[str]:
    """The sentences and lines of a text, in order; blank ones and code fences are none."""
    out: list[str] = []
    for u in SENTENCE.split(text):
        if u and not u.isspace() and not FENCE.match(u):
            if out and LABEL.fullmatch(out[-1]):
                u = f"{out.pop()} {u}"
            out.append(u)
    return out


def words(unit: str) -> list[str]:
    return WORD.findall(unit.lower())


def form(unit: str) -> str | None:
    """Program text deals with software, formulas with mathematics."""
    if ADDRESS.search(unit):
        return None
    if FORMULA.search(unit):
        return MATHEMATICS
    if len(unit) < 400 and CODE.search(unit) and not re.search(r"[.!?”]$|[ऀ-ഀ]", unit):
        return SOFTWARE
    return None


class Lexicon:
    """Word weights by subject; the last class is no subject."""

    def __init__(self, subjects: list[str], vocabulary: dict[str, int], weights: np.ndarray, prior: np.ndarray) -> None:
        self.subjects, self.vocabulary, self.weights, self.prior = subjects, vocabulary, weights, prior

    def posterior(self, tokens: list[str]) -> np.ndarray | None:
        ids = [self.vocabulary[w] for w in tokens if w in self.vocabulary]
        if not ids:
            return None
        score = self.prior + self.weights[ids].sum(0)
        p = np.exp(score - score.max())
        return p / p.sum()

    def batch(self, lists: list[list[str]]) -> np.ndarray:
        """[list, class] posteriors; a list without known words gets the prior."""
        get = self.vocabulary.get
        ids = [[i for w in tokens if (i := get(w)) is not None] for tokens in lists]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        total = np.zeros((len(lists), len(self.prior)), np.float32)
        filled = np.flatnonzero(sizes)
        if len(filled):
            total[filled] = np.add.reduceat(self.weights[flat], (np.cumsum(sizes) - sizes)[filled])
        total += self.prior
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)


def fit_lexicon(texts: list[str], labels: list[set[str]], subjects: list[str]) -> Lexicon:
    """A mixture of words fitted by expectation-maximization. A sentence deals with one of its document's labels or none;
    other subjects are possible with little prior, as labels may be missing or wrong."""
    at = {s: k for k, s in enumerate(subjects)}
    classes = len(subjects) + 1
    docs, lists, in_doc, in_docs = [], [], [], Counter()
    for d, text in enumerate(texts):
        parts = units(text)
        forms = Counter(form(u) for u in parts)
        if any(s in labels[d] and n >= SHARE * len(parts) for s, n in forms.items()):
            parts = []  # the form of the text explains a label; which words do is unknown
        own = [words(u) for u in parts if form(u) is None]
        in_doc.append({w for u in own for w in u})
        in_docs.update(in_doc[-1])
        for u in own:
            docs.append(d)
            lists.append(u)
    # terms: words whose documents have some subject clearly more often than documents have it
    share_of = np.zeros((len(texts), classes))
    for d, own in enumerate(labels):
        known = [at[s] for s in own if s in at]
        share_of[d, known] = 1 / max(len(known), 1)
        share_of[d, -1] = 0 if known else 1
    used = np.array([bool(w) for w in in_doc])
    base = share_of[used].mean(0) + 1e-9 if used.any() else np.full(classes, 1 / classes)
    needed = LIFT * base / (1 - base + LIFT * base)
    by_word: dict[str, np.ndarray] = {w: np.zeros(classes) for w, n in in_docs.items() if n >= LEAST_DOCS}
    for d, text in enumerate(texts):
        for w in in_doc[d]:
            if w in by_word:
                by_word[w] += share_of[d]
    kept = []
    for w, c in sorted(by_word.items()):
        n = c.sum()
        low = (c - np.sqrt(c)) / n  # a cautious share
        if (low[:-1] >= needed[:-1]).any() and c[:-1].max() >= 1.5:
            kept.append(w)
    vocabulary = {w: k for k, w in enumerate(kept)}
    ids = [[vocabulary[w] for w in u if w in vocabulary] for u in lists]
    filled = [k for k, u in enumerate(ids) if u]
    if not filled:
        return Lexicon(subjects, {}, np.zeros((0, classes), np.float32), np.log(np.full(classes, 1 / classes)))
    sizes = np.array([len(ids[k]) for k in filled])
    flat = np.fromiter((i for k in filled for i in ids[k]), np.int64)
    unit = np.repeat(np.arange(len(filled)), sizes)
    starts = np.cumsum(sizes) - sizes
    prior = (1 - LABEL_TRUST) / classes + LABEL_TRUST * np.where(share_of[:, -1:] == 1, np.eye(classes)[-1], 0.9 * share_of + 0.1 * np.eye(classes)[-1])
    mine = np.log(prior[np.array(docs)[filled]]).astype(np.float32)
    whole = np.bincount(flat, minlength=len(kept)) + ALPHA
    share = np.exp(mine)
    share /= share.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        counts = np.stack([np.bincount(flat, share[unit, c], len(kept)) for c in range(classes)], 1) + ALPHA
        counts[:, -1] = whole  # no subject has no words of its own: it stays at the mean of all
        weights = np.log(counts / counts.sum(0)).astype(np.float32)
        score = np.add.reduceat(weights[flat], starts) + mine
        share = np.exp(score - score.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    weights -= weights.max(1, keepdims=True)
    return Lexicon(subjects, vocabulary, weights, np.log(share.mean(0) + 1e-6).astype(np.float32))


def labels_of(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, labels): the labelled documents, each with its distinct valid labels; "none" and unknown spellings give none."""
    form = F.lower(F.trim("subject"))
    valid = F.when(form.isin(subjects), form)
    return labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set(valid).alias("labels"))


def sample(labelled: DataFrame) -> DataFrame:
    return labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)


def source_form(source) -> F.Column:
    return F.replace(F.lower(F.trim(source)), F.lit("_"), F.lit("-"))


def fit(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> tuple[Lexicon, dict[str, int]]:
    """The lexicon, and the subject of each source that has one."""
    subjects = sorted(r[0] for r in few(areas.where("subject is not null").select("subject").distinct(), AREAS, "subject areas"))
    chosen = materialize(sample(labels_of(labels, subjects)), "labelled")  # LABELLED rows at most
    own = docs.where("text is not null").select("doc_id", source_form(F.col("source")).alias("source"), "text")
    rows = own.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").toArrow()
    texts, sets = rows["text"].to_pylist(), [set(x) for x in rows["labels"].to_pylist()]
    by_source: dict[str, Counter] = defaultdict(Counter)
    total = Counter()
    for s, own in zip(rows["source"].to_pylist(), sets):
        total[s] += 1
        by_source[s].update(own)
    sources = {}
    for s, n in total.items():
        if s is not None and n >= 5 and by_source[s]:
            best, hits = by_source[s].most_common(1)[0]
            if hits > n / 2:
                sources[s] = subjects.index(best)
    return fit_lexicon(texts, sets, subjects), sources


def _votes(batches: Iterator[pa.RecordBatch], fitted) -> Iterator[pa.RecordBatch]:
    """For each document how often each pattern of votes occurs; a pattern is a number in base classes + 1."""
    lexicon, sources = fitted.value
    n, base = len(lexicon.subjects), len(lexicon.subjects) + 2  # vote 0: abstains; 1..n: subject; n + 1: no subject
    at = {s: k + 1 for k, s in enumerate(lexicon.subjects)}
    weights = base ** np.arange(len(FUNCTIONS), dtype=np.int64)
    for batch in batches:
        names = batch.schema.names
        texts, origin = batch.column(names.index("text")).to_pylist(), batch.column(names.index("source")).to_pylist()
        parts = [units(t) for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        flat = [u for p in parts for u in p]
        if not flat:
            continue
        tokens = [words(u) for u in flat]
        p = lexicon.batch(tokens)
        best, top = p.argmax(1), p.max(1)
        vote = np.zeros((len(flat), len(FUNCTIONS)), np.int64)
        known = np.array([any(w in lexicon.vocabulary for w in t) for t in tokens])
        vote[:, 2] = [at.get(form(u), 0) for u in flat]
        prose = known & (vote[:, 2] == 0)  # the words of program text and formulas are names
        vote[:, 0] = np.where(prose & (top >= CLEAR), best + 1, 0)
        vote[:, 1] = np.where(prose & (top < CLEAR) & (top >= WEAK), best + 1, 0)
        vote[:, 5] = np.array([sources.get(s, -1) + 1 for s in origin])[doc]
        heading, last = 0, -1
        for k, u in enumerate(flat):
            if doc[k] != last:
                heading, last = 0, doc[k]
            if HEADING.match(u):
                heading = vote[k, 0] if vote[k, 0] <= n else 0
            else:
                vote[k, 3] = heading
            if ("](" in u or "@" in u or "www." in u or "://" in u) and (found := ADDRESS.findall(u)):
                q = lexicon.posterior(words(" ".join(found).replace("_", " ")))
                if q is not None and q.max() >= WEAK and q.argmax() < n:
                    vote[k, 4] = q.argmax() + 1
        pattern = vote @ weights
        counted = np.array([not HEADING.match(u) and (vote[k, 4] > 0 or "](" not in u) for k, u in enumerate(flat)])
        pattern, doc = pattern[counted], doc[counted]  # headings and mere links are no sentences
        keys, times = np.unique(np.stack([doc, pattern], 1), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")).take(pa.array(keys[:, 0])), pa.array(keys[:, 1]), pa.array(times)], names=["doc_id", "pattern", "n"])


def learn_accuracies(patterns: np.ndarray, times: np.ndarray, classes: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """([function] accuracy, [pattern, class] posterior) of the latent subject of a sentence, by expectation-maximization.

    A function that votes names the true class with its accuracy and else any other one alike. Accuracies are
    learned from the sentences on which several functions vote, as a lone vote says nothing of its accuracy. A
    sentence without a vote deals with no subject; of the others every class is as likely beforehand.
    """
    base = classes + 1
    votes = np.stack([patterns // base**j % base for j in range(len(FUNCTIONS))], 1)
    believed = np.array([0.95, 0.7, 0.9, 0.6, 0.6, 0.4])  # counts as ten sentences of evidence
    accuracy = believed.copy()
    silent = ~(votes > 0).any(1)
    several = times * ((votes > 0).sum(1) > 1)
    for _ in range(rounds):
        score = np.zeros((len(patterns), classes))
        score[silent, :-1] = -np.inf
        for j in range(len(FUNCTIONS)):
            on = np.flatnonzero(votes[:, j])
            wrong = np.log((1 - accuracy[j]) / (classes - 1))
            score[on] += wrong
            score[on, votes[on, j] - 1] += np.log(accuracy[j]) - wrong
        post = np.exp(score - score.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * several[:, None]
        for j in range(len(FUNCTIONS)):
            on = np.flatnonzero(votes[:, j])
            right = mass[on, votes[on, j] - 1].sum()
            accuracy[j] = np.clip((right + 10 * believed[j]) / (mass[on].sum() + 10), 0.15, 0.995)
    return accuracy, post


def subject_shares(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, share, units): for each document each subject some of its sentences deal with, and the share.

    Null or blank texts have no row. Rows that repeat a doc_id add to the same document. Extra columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    lexicon, sources = fit(docs, labels, areas)
    if not lexicon.subjects:
        return spark.createDataFrame([], "doc_id long, subject string, share double, units long")
    fitted = spark.sparkContext.broadcast((lexicon, sources))
    given = docs.where("doc_id is not null and length(trim(text)) > 0").select("doc_id", source_form(F.col("source")).alias("source"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    voted = materialize(given.mapInArrow(lambda it: _votes(it, fitted), f"doc_id {kind}, pattern long, n long"), "votes")
    counts = voted.groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()  # bounded by the classes to the power of the functions
    patterns, times = counts["pattern"].to_numpy(), counts["n"].to_numpy().astype(float)
    order = np.argsort(patterns)
    patterns, times = patterns[order], times[order]
    classes = len(lexicon.subjects) + 1
    _, post = learn_accuracies(patterns, times, classes) if len(patterns) else (None, np.zeros((0, classes)))
    winner = post.argmax(1)
    named = spark.createDataFrame([(int(p), lexicon.subjects[w] if w < classes - 1 else None) for p, w in zip(patterns, winner)], "pattern long, subject string")
    told = voted.join(F.broadcast(named), "pattern").groupBy("doc_id", "subject").agg(F.sum("n").alias("n"))
    whole = told.groupBy("doc_id").agg(F.sum("n").alias("units"), F.collect_list(F.struct("subject", "n")).alias("own"))
    each = whole.select("doc_id", "units", F.inline("own")).where("subject is not null")
    return each.select("doc_id", "subject", (F.col("n") / F.col("units")).alias("share"), "units")


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, share: float = SHARE) -> DataFrame:
    """The subjects that at least ``share`` of a document's sentences deal with."""
    return subject_shares(docs, labels, areas).where(F.col("share") >= share)


def composition(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, documents, sentences): how much of the corpus deals with each subject; documents without subject as null."""
    shares = materialize(subject_shares(docs, labels, areas), "shares")
    found = shares.where(F.col("share") >= SHARE).groupBy("subject").agg(F.count("*").alias("documents"))
    told = shares.groupBy("subject").agg(F.sum(F.round(F.col("share") * F.col("units"))).cast("long").alias("sentences"))
    own = shares.where(F.col("share") >= SHARE).select("doc_id").distinct()
    rest = docs.where("doc_id is not null").select("doc_id").distinct().join(own, "doc_id", "left_anti").agg(F.lit(None).cast("string").alias("subject"), F.count("*").alias("documents"), F.lit(None).cast("long").alias("sentences"))
    return told.join(found, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).alias("documents"), "sentences").unionByName(rest)
