"""Toxicity: significant passages by maximum-scoring segments over word log-odds.

A word's score is the log-odds of its document counts in toxic and in clean labelled documents, both
smoothed by a Dirichlet prior in proportion to the word's count over all documents, drawn towards zero
by its standard error, minus a constant, so that a clean text drifts down.  One linear pass over a
text (Ruzzo and Tompa's) finds all its maximal segments.  By the theory of such segments a clean text of n
words has K n exp(-lambda S) segments of score S or more; lambda is the root of the score equation under the clean
words' distribution, K is fitted on clean documents.  A document's evidence is what its
significant segments have in surprise, and a logistic curve, fitted on documents whose fold took no part in
the scores that they were searched with, turns that into a probability.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, share, small
from .text import remainder, word_blocks

#: Labelled documents that are learned from, chosen by a hash of their id, and folds of them.
LABELLED, FOLDS = 20_000, 4
#: Weight of the prior in counts, what every word has of it, standard errors that a score loses, drift of a word.
PRIOR, LEAST, ERRORS, DRIFT = 20.0, 0.1, 1.0, 0.25
#: Passages that a clean document of its length has at most so often, on average, are significant.
EXPECTED = 0.05
_PUNCTUATION = string.punctuation + "¡¿«»„“”’…–—"


def plain(words: pa.Array) -> list[str]:
    """Words without case and outer punctuation; signs alone are left as they are."""
    return [w.strip(_PUNCTUATION).lower() or w for w in words.to_pylist()]


def word_documents(docs: DataFrame, groups: int) -> DataFrame:
    """``word, n0, n1, ...``: documents of each group that hold the word; ``docs`` has ``text, part``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, words, codes, sizes in word_blocks(b.column(0), lower=False):
                if not len(codes):
                    continue
                names, own = np.unique(np.array(plain(words), object), return_inverse=True)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                pair = np.unique(owner * len(names) + own[codes])  # a document counts once for a word
                counts = np.zeros((len(names), groups), np.int64)
                np.add.at(counts, (pair % len(names), part[at + pair // len(names)]), 1)
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), *(pa.array(c) for c in counts.T)], ["word", *(f"n{k}" for k in range(groups))])

    columns = [f"n{k}" for k in range(groups)]
    made = docs.select("text", "part").mapInArrow(task, "word string, " + ", ".join(f"{c} long" for c in columns))
    return made.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns))


def log_odds(bg: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_bg: float, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores of words, and their probability in clean text, from counts; n: sums of counts over all words."""
    prior = PRIOR * bg / max(1.0, n_bg) + LEAST
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (n_toxic + PRIOR)) - np.log(b / (n_clean + PRIOR))
    sure = np.maximum(0.0, np.abs(odds) - ERRORS * np.sqrt(1 / a + 1 / b))
    return np.sign(odds) * sure - DRIFT, b / (n_clean + PRIOR)


def decay(scores: np.ndarray, chance: np.ndarray) -> float:
    """The positive root lambda of sum p exp(lambda s) = 1; all words that aren't given score -DRIFT."""
    rest = max(0.0, 1.0 - chance.sum())
    excess = lambda x: rest * np.exp(-x * DRIFT) + (chance * np.exp(np.minimum(x * scores, 700))).sum() - 1
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    return high


def segments(at: np.ndarray, gain: np.ndarray, loss: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal segments ``(score, first, last)`` of a text: positive words at ``at`` score ``gain``, and
    ``loss`` is the sum of all scores before each (itself not included).

    Each candidate keeps the sum before it and through it, and the one before it that starts lower, so
    each is looked at a bounded number of times.
    """
    left: list[float] = []
    right: list[float] = []
    first: list[int] = []
    last: list[int] = []
    lower: list[int] = []
    for p, g, low in zip(at.tolist(), gain.tolist(), loss.tolist(), strict=True):
        high, begin = low + g, p
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = lower[j]
            if j < 0 or right[j] >= high:
                break
            low, begin = left[j], first[j]
            del left[j:], right[j:], first[j:], last[j:], lower[j:]
        left.append(low)
        right.append(high)
        first.append(begin)
        last.append(p)
        lower.append(j)
    return [(r - a, f, z) for a, r, f, z in zip(left, right, first, last, strict=True)]


def found_segments(texts: pa.Array, scores: dict[str, float]) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
    """Number of words and maximal segments of each text."""
    for _, words, codes, sizes in word_blocks(texts, lower=False):
        own = np.array([scores.get(w, -DRIFT) for w in plain(words)], np.float64)
        each = own[codes] if len(codes) else np.zeros(0)
        before = np.cumsum(each) - each
        stop = np.cumsum(sizes)
        up = np.flatnonzero(each > 0)
        edge = np.searchsorted(up, stop)
        begin = np.append(0, edge[:-1])
        for k, n in enumerate(sizes.tolist()):
            some = up[begin[k] : edge[k]]
            yield n, segments(some - (stop[k] - n), each[some], before[some]) if len(some) else []


@dataclass
class Model:
    """Word scores, the two parameters of chance segments and the curve of evidence."""

    scores: dict[str, float]
    decay: float
    rate: float = 1.0
    slope: float = 0.0
    start: float = 0.0

    def surprise(self, n: int, score: float) -> float:
        """Minus the logarithm of how many such segments a clean text of n words has."""
        return self.decay * score - float(np.log(max(self.rate * n, 1e-300)))

    def significant(self, n: int, found: list[tuple[float, int, int]]) -> list[tuple[float, int, int, float]]:
        least = -np.log(EXPECTED)
        made = [(s, a, b, self.surprise(n, s)) for s, a, b in found]
        return [m for m in made if m[3] >= least]

    def evidence(self, n: int, found: list[tuple[float, int, int]]) -> float:
        return float(np.log1p(sum(m[3] for m in self.significant(n, found))))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.start, -500, 500)))


def chance_rate(lengths: np.ndarray, best: np.ndarray, decay: float) -> float:
    """K of clean texts, most likely where texts without a segment are censored at zero."""
    some = float((best > 0).sum())
    return max(some, 0.5) / max(float((lengths * np.exp(-decay * best)).sum()), 1e-9)


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and start of a logistic curve, fitted by Newton's steps to smoothed labels, the slope at least zero."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    start = float(np.log((pos + 1) / (neg + 1)))
    if not pos or not neg:
        return 0.0, start
    w = np.array([0.0, start])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, a.T @ (target - p) - np.array([1e-2, 1e-6]) * w)
        w = w + step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, start)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELLED) -> Model:
    """A model from the labelled documents; words count over all ``docs`` for the prior.

    An id that has both labels is toxic if at least half of its rows say so; documents that share an id count as
    one, by the text that comes first.  Only words whose score isn't the common drift come to the
    driver: each needs several labelled documents, of which there are about ``most`` at most.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))
    chosen = small(share(cut(known.where("_id is not null"), "known"), "_id", most), "chosen")
    rows = docs.select(F.col(doc_id).cast("long").alias("_d"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = rows.join(chosen, F.col("_d") == F.col("_id")).groupBy("_id", "y").agg(F.min("text").alias("text"))
    own = cut(own.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(FOLDS)).cast("int")), "labelled")
    # groups of the labelled: 2 * fold + label; in the count of all documents a word has one group
    counts = cut(word_documents(own.withColumn("part", F.col("fold") * 2 + F.col("y")), 2 * FOLDS), "counts")
    every = word_documents(rows.withColumn("part", F.lit(0)), 1).select(F.col("word").alias("_w"), F.col("n0").alias("bg"))
    every = cut(every, "words")
    sizes = counts.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(2 * FOLDS))).first()
    n_bg = float(every.agg(F.coalesce(F.sum("bg"), F.lit(0))).first()[0])
    # a word in fewer than two labelled documents can't be far enough from zero
    joined = counts.where(" + ".join(f"n{k}" for k in range(2 * FOLDS)) + " >= 2").join(every, counts.word == every._w).drop("_w")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            n = np.stack([cols[f"n{k}"].to_numpy() for k in range(2 * FOLDS)], 1).astype(float)
            keep = np.zeros(b.num_rows, bool)
            for fold in range(FOLDS + 1):
                s, _ = _fold_scores(n, cols["bg"].to_numpy().astype(float), total, n_bg, fold)
                keep |= s != -DRIFT
            yield b.filter(pa.array(keep))

    total = np.array([sizes[f"n{k}"] for k in range(2 * FOLDS)], float)
    table = joined.mapInArrow(task, joined.schema).toArrow().sort_by("word")
    words = table["word"].to_pylist()
    n = np.stack([table[f"n{k}"].to_numpy() for k in range(2 * FOLDS)], 1).astype(float) if words else np.zeros((0, 2 * FOLDS))
    bg = table["bg"].to_numpy().astype(float)
    models = []
    for fold in range(FOLDS + 1):
        s, chance = _fold_scores(n, bg, total, n_bg, fold)
        models.append(Model({w: float(x) for w, x in zip(words, s, strict=True) if x != -DRIFT}, decay(s, chance)))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, y, texts, fold = b.columns
            kinds = fold.to_numpy()
            for k in np.unique(kinds):
                mine = pa.array(kinds == k)
                got = list(found_segments(texts.filter(mine), shared.value[k].scores))
                yield pa.RecordBatch.from_arrays([
                    ids.filter(mine), y.filter(mine), fold.filter(mine), pa.array([g[0] for g in got], pa.int64()), pa.array([[s for s, _, _ in g[1]] for g in got], pa.list_(pa.float64()))],
                    ["id", "y", "fold", "n", "found"])

    seen = own.select("_id", "y", "text", "fold").mapInArrow(search, "id long, y int, fold int, n long, found array<double>")
    # of a document that may be long only what a score of its own needs comes along
    seen = seen.withColumn("found", F.slice(F.sort_array("found", False), 1, 256)).toArrow().sort_by("id")
    model = models[FOLDS]
    y, lengths, found = seen["y"].to_numpy(), seen["n"].to_numpy().astype(float), seen["found"].to_pylist()
    rates = np.array([models[k].decay for k in seen["fold"].to_numpy()], float)
    best = np.array([max(f, default=0.0) for f in found], float)
    clean = y == 0
    # scores of folds are brought to one scale by their own decay
    scaled = best * rates / model.decay if len(best) else best
    model.rate = chance_rate(lengths[clean], scaled[clean], model.decay)
    evidence = np.array([model.evidence(int(n_), [(s * r / model.decay, 0, 0) for s in f]) for n_, f, r in zip(lengths, found, rates, strict=True)], float)
    model.slope, model.start = curve(evidence, y.astype(float))
    return model


def _fold_scores(n: np.ndarray, bg: np.ndarray, total: np.ndarray, n_bg: float, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores without the documents of a fold (of all documents for FOLDS)."""
    keep = np.array([k // 2 != fold for k in range(2 * FOLDS)])
    toxic, clean = keep & (np.arange(2 * FOLDS) % 2 == 1), keep & (np.arange(2 * FOLDS) % 2 == 0)
    return log_odds(bg, n[:, toxic].sum(1), n[:, clean].sum(1), n_bg, float(total[toxic].sum()), float(total[clean].sum()))


def detect(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELLED) -> DataFrame:
    """``doc_id, score, predicted, passages`` for every row.

    ``labels`` are the rows to learn from: ids with 0 or 1, null labels and ids ignored.  ``passages`` are the
    significant segments, in order: first and last word (counted from 0), score, and how many such a clean
    text of this length has.  Rows with equal or null ids are scored each by itself.  Null and empty texts
    have no passage and the score of that; with labels of one kind only, or none, every score is the
    smoothed share of toxic labels (a half without labels).  Other columns are ignored; an empty
    table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, doc_id, text, label, most))
    passage = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            got = list(found_segments(b.column(1), m.scores))
            score = m.probability(np.array([m.evidence(n, f) for n, f in got], float))
            shown = [[{"first": a, "last": z, "score": s, "expected": float(np.exp(-x))} for s, a, z, x in m.significant(n, f)] for n, f in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(shown, pa.list_(passage))], ["doc_id", "score", "predicted", "passages"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(task, "doc_id long, score double, predicted int, passages array<struct<first:long,last:long,score:double,expected:double>>")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = detect(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
