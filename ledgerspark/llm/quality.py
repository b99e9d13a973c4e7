"""Quality scores: random-indexing word vectors pooled per document, and a small neural network.

Every word has a sparse random index vector; its vector is that plus the sum of the index vectors of
its neighbours over the whole corpus.  Words go to a fixed number of hashed places, so vectors have a
bounded size.  Beside the word itself, its shape (case, punctuation, whether it repeats the word
before) is a word of a second vocabulary with vectors of the same kind.  A document is the mean of
its words' and shapes' vectors and the logarithm of its length.  A two-layer network, trained in
numpy, gives a logit; a temperature fitted on labelled documents that it wasn't trained on makes it a
calibrated probability.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, share
from .text import partial_sums, remainder, total, word_blocks

WIDTH, SPARSE = 48, 4
WORD_PLACES, SHAPE_PLACES = 1 << 13, 1 << 10
#: Labelled documents that the network is fitted on, chosen by a hash of their id.
LABELLED = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 0.003, 1e-4
#: Every fifth labelled document sets the temperature and is not trained on.
CALIBRATE = 5

_PUNCTUATION = string.punctuation + "¡¿«»„“”’…–—"


def shape(word: str) -> str:
    """Case class of the letters between up to three signs of leading and trailing punctuation."""
    core = word.strip(_PUNCTUATION)
    if not core:
        return word[:3]
    at = word.index(core)
    kind = "a" if core.islower() else "A" if core.isupper() and len(core) > 1 else "Aa" if core[0].isupper() else "9" if core.isdigit() else "?"
    return f"{word[:at][-3:]}{kind}{word[at + len(core) :][:3]}"


def places(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of words (without case and outer punctuation) and of their shapes."""
    w = words.to_pylist()
    own = [zlib.crc32(x.strip(_PUNCTUATION).lower().encode()) % WORD_PLACES for x in w]
    look = [zlib.crc32(shape(x).encode()) % (SHAPE_PLACES // 2) for x in w]
    return np.array(own, np.int64), np.array(look, np.int64)


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts as places of words, places of shapes and words per text."""
    for at, words, codes, sizes in word_blocks(texts, lower=False):
        own, look = places(words)
        again = np.append(False, codes[1:] == codes[:-1]) if len(codes) else np.zeros(0, bool)
        stop = np.cumsum(sizes)
        begin = (stop - sizes)[sizes > 0]
        again[begin] = False
        yield at, own[codes], look[codes] + again * (SHAPE_PLACES // 2), sizes


def index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(seed)
    return g.integers(0, WIDTH, (n, SPARSE)), g.choice([-1.0, 1.0], (n, SPARSE))


def neighbour_sums(ids: np.ndarray, first: np.ndarray, n: int, seed: int) -> np.ndarray:
    """For each place, the sum of the index vectors of what stands next to it in a text."""
    where, sign = index_vectors(n, seed)
    link = np.ones(len(ids), bool)
    link[first] = False
    link = np.flatnonzero(link)
    pair, times = np.unique(ids[link - 1] * n + ids[link], return_counts=True)
    out = np.zeros(n * WIDTH)
    for a, b in ((pair // n, pair % n), (pair % n, pair // n)):
        for k in range(SPARSE):
            out += np.bincount(a * WIDTH + where[b, k], sign[b, k] * times, n * WIDTH)
    return out


def word_vectors(docs: DataFrame, text: str = "text", seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of word and shape places from all of ``docs``."""

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        got = None
        for b in batches:
            for _, own, look, sizes in tokens(b.column(0)):
                first = (np.cumsum(sizes) - sizes)[sizes > 0]
                part = np.concatenate([neighbour_sums(own, first, WORD_PLACES, seed), neighbour_sums(look, first, SHAPE_PLACES, seed + 1)])
                got = part if got is None else got + part
        return got

    sums = total(partial_sums(docs.select(text), add))
    if sums is None:
        sums = np.zeros((WORD_PLACES + SHAPE_PLACES) * WIDTH)
    out = []
    for part, n, s in ((sums[: WORD_PLACES * WIDTH], WORD_PLACES, seed), (sums[WORD_PLACES * WIDTH :], SHAPE_PLACES, seed + 1)):
        v = part.reshape(n, WIDTH)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        where, sign = index_vectors(n, s)
        np.add.at(v, (np.arange(n)[:, None], where), sign)
        out.append(v.astype(np.float32))
    return out[0], out[1]


def pooled(docs: DataFrame, vectors: tuple[np.ndarray, np.ndarray], doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``doc_id, row, features`` for every row; a text without words has all zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, own, look, sizes in tokens(b.column(1)):
                out = np.zeros((len(sizes), 2 * WIDTH + 1), np.float32)
                some = np.flatnonzero(sizes)
                begin = (np.cumsum(sizes) - sizes)[some]
                for k, (ids, v) in enumerate(zip((own, look), shared.value, strict=True)):
                    if len(ids):
                        out[some, k * WIDTH : (k + 1) * WIDTH] = means(ids, v, begin, sizes[some])
                out[:, -1] = np.log1p(sizes)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sizes)), b.column(2).slice(at, len(sizes)), pa.array([r.tobytes() for r in out], pa.binary())], ["doc_id", "row", "features"])

    number = F.col(row) if row else F.lit(None)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), number.cast("long").alias("row"))
    return cut(rows.mapInArrow(task, "doc_id long, row long, features binary"), "features")


def means(ids: np.ndarray, v: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean vector of each text; at most some hundred thousand words are looked up at a time."""
    out, step = np.zeros((len(begin), v.shape[1])), 200_000
    owner = np.repeat(np.arange(len(begin)), sizes)
    for at in range(0, len(ids), step):
        o = owner[at : at + step]
        edge = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        out[o[edge]] += np.add.reduceat(v[ids[at : at + step]], edge, axis=0)
    return out / sizes[:, None]


class Network:
    """Standardised features, one hidden layer of tanh units, a logit and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 23):
        g = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.temperature = 1.0
        held = np.arange(len(x)) % CALIBRATE == 0
        x = (x - self.mean) / self.scale
        d = x.shape[1]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.p = [g.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(rate / (1 - rate)) * np.ones(1)]
        t, ty = x[~held], y[~held]
        m, v, n = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS if len(t) else 0):
            order = g.permutation(len(t))
            for at in range(0, len(t), BATCH):
                k, n = order[at : at + BATCH], n + 1
                h = np.tanh(t[k] @ self.p[0] + self.p[1])
                e = (sigmoid(h @ self.p[2] + self.p[3]) - ty[k]) / len(k)
                back = e[:, None] * self.p[2] * (1 - h * h)
                for i, grad in enumerate((t[k].T @ back + DECAY * self.p[0], back.sum(0), h.T @ e + DECAY * self.p[2], e.sum(keepdims=True))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad * grad
                    self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**n)) / (np.sqrt(v[i] / (1 - 0.999**n)) + 1e-8)
        if held.sum() > 1:
            z, cy = self._logit(x[held]), y[held]
            loss = lambda s: np.logaddexp(0, np.where(cy > 0, -z, z) / s).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._logit((x - self.mean) / self.scale) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED, row: str | None = None) -> DataFrame:
    """``doc_id, score, predicted`` for every row, and ``row`` if a column of numbers is named.

    ``labels`` are the rows to learn from: ids with 0 or 1, null labels ignored; an id that has both
    counts as 1 if most of its rows do.  About ``most`` labelled documents are used, all
    if there are no more; rows that share a labelled id are one of them.  Null and empty
    texts have a score too; without labels every score is 0.5.  Rows with equal or null ids are scored
    each by itself; other columns are ignored; an empty table gives no rows.
    """
    features = pooled(docs, word_vectors(docs, text), doc_id, text, row)
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_id")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))
    chosen = share(cut(known, "known"), "_id", most)
    # rows that share a labelled id are one example, so that the chosen ids bound what is collected
    rows = features.join(chosen, features.doc_id == chosen._id).groupBy("doc_id", "y").agg(F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    x = np.frombuffer(b"".join(r.features for r in rows), "<f4").reshape(-1, 2 * WIDTH + 1).astype(float)
    net = docs.sparkSession.sparkContext.broadcast(Network(x, np.array([r.y for r in rows], float)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(2).to_pylist()), "<f4").reshape(b.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(net.value.probability(x))], ["doc_id", "row", "score"])

    scored = features.mapInArrow(task, "doc_id long, row long, score double")
    scored = scored if row else scored.drop("row")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = classify(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
