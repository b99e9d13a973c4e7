"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The model predicts a token from the two before it: the vectors of both, weighted by position, give a
vector whose product with a class's output vector, plus its bias, is the class's logit.  The logits are
sums of one term per context word, so the normaliser of every pair of context classes is an entry of one
matrix product, and a token's normalised log probability is read off three tables.

A class is a frequent word, or one of the classes over which the hash of a word deals all others, so
every word of a vocabulary of any size has a vector, as context and as output.  Within a class the counts
of the whole training corpus divide its probability.  Counts of frequent words (a bounded number) travel
to all tasks; the others are joined.

All training documents take part, once.  They are dealt by their own hash over rounds, and in a round over
shards of about SHARD_TOKENS tokens, which every partitioning of the table leaves the same; each shard is
trained on from the round's common start, and the parameters are averaged by tokens after each round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut
from .text import partial_sums, remainder, total, word_blocks

#: Classes (a quarter of them for the words that have none of their own), and components of a vector.
VOCABULARY, WIDTH = 2048, 16
#: Rounds of training at least, tokens of a shard, and tokens of which each doubling adds a round.
ROUNDS, SHARD_TOKENS, ROUND_TOKENS = 3, 500_000, 50_000_000
#: Words whose counts are sent to every task.
HEAD = 50_000
NOISE, BATCH, RATE = 64, 2048, 0.05
END = ""


class Counts:
    """Counts of a training corpus: frequent words here, all of them in ``table`` (word, c)."""

    def __init__(self, table: DataFrame, head: int = HEAD):
        self.table = table
        n, v = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.tokens, self.distinct = int(n), int(v)
        # words are taken by classes of counts, the most frequent first, as long as all of a class fit, so
        # that tasks send no more than the head between them
        level = F.floor(F.log2("c") * 16)
        size, least, more = 0, None, F.lit(False)
        for r in sorted(table.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
            size += r["count"]
            if size > head:  # of the class that doesn't fit a share, by hash
                part = 1 - (size - head) / r["count"]
                more = (level == r.level) & (F.pmod(F.xxhash64(F.lit("head"), "word"), F.lit(1 << 20)) < int(part * (1 << 20)))
                break
            least = r.level
        whole = F.lit(False) if least is None else level >= least
        rows = table.where((whole | more) & (F.col("word") != END)).collect()
        rows.sort(key=lambda r: (-r.c, r.word))
        end = table.where(F.col("word") == END).first()
        self.words = [END, *(r.word for r in rows)]
        self.c = np.array([end.c if end else 0, *(r.c for r in rows)], np.int64)

    def classes(self, size: int) -> Classes:
        """``size`` classes: the most frequent words, and what is left of every hashed class."""
        shared = max(1, size // 4)
        known = min(size - shared, len(self.words))
        tokens, distinct = np.zeros(shared, np.int64), np.zeros(shared, np.int64)
        for r in self.table.groupBy((F.crc32(F.col("word").cast("binary")) % shared).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
            tokens[r.k], distinct[r.k] = r.c, r.v
        own = [hashed(w, shared) for w in self.words[:known]]
        np.subtract.at(tokens, own, self.c[:known])
        np.subtract.at(distinct, own, (self.c[:known] > 0).astype(np.int64))
        return Classes(self.words[:known], self.c[:known], tokens, distinct)


def hashed(word: str, shared: int) -> int:
    return zlib.crc32(word.encode()) % shared


class Classes:
    """Words with a class of their own, and tokens and distinct words of the hashed classes after them."""

    def __init__(self, words: list[str], c: np.ndarray, tokens: np.ndarray, distinct: np.ndarray):
        self.words, self.shared, self.known = words, len(tokens), len(words)
        count = np.append(c, tokens) + 1.0
        self.prob = count / count.sum()
        #: what the counts of a class's words are divided by; its last part is for words that training didn't see
        self.spread = np.log10(tokens + distinct + 1.0)
        self.id = {w: k for k, w in enumerate(words)}

    def of(self, words: list[str]) -> np.ndarray:
        get, known, shared = self.id.get, self.known, self.shared
        out = [get(w) for w in words]
        return np.array([known + hashed(w, shared) if k is None else k for w, k in zip(words, out, strict=True)], np.int64)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, c`` over whole texts, one end (the empty word) for each text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, words, codes, sizes in word_blocks(b.column(0)):
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)))], ["word", "c"])
                yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([len(sizes)], pa.int64())], ["word", "c"])

    return cut(docs.select(text).mapInArrow(task, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")


class Model:
    """Parameters in one array: input and output vectors, biases, position weights."""

    def __init__(self, size: int, width: int, flat: np.ndarray, classes: Classes | None = None):
        self.size, self.width, self.flat, self.classes = size, width, flat, classes
        cuts = np.cumsum([size * width, size * width, size, width, width])
        r, q, self.b, self.near, self.far = np.split(flat, cuts[:-1])
        self.r, self.q = r.reshape(size, width), q.reshape(size, width)

    @classmethod
    def start(cls, prob: np.ndarray, width: int, seed: int = 7, classes: Classes | None = None) -> Model:
        g = np.random.default_rng(seed)
        n = len(prob)
        return cls(n, width, np.concatenate([g.normal(0, 0.1, 2 * n * width), np.log(prob), np.full(width, 0.6), np.full(width, 0.3)]), classes)

    def step(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray, noise: np.ndarray, offset: np.ndarray, gather: Model, rate: float) -> None:
        """One Adagrad step of noise-contrastive estimation; ``offset`` is log(k * noise probability)."""
        r1, r2, qw, qn = self.r[w1], self.r[w2], self.q[w], self.q[noise]
        pred = r1 * self.near + r2 * self.far
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        good = 1 - sigmoid((pred * qw).sum(1) + self.b[w] - offset[w])
        bad = -sigmoid(pred @ qn.T + (self.b[noise] - offset[noise]))
        d = good[:, None] * qw + bad @ qn
        grad = Model(self.size, self.width, np.zeros_like(self.flat))
        rows = lambda ids, x: np.stack([np.bincount(ids, x[:, j], self.size) for j in range(self.width)], 1)
        grad.r[:] = rows(w1, d * self.near) + rows(w2, d * self.far)
        grad.q[:] = rows(w, good[:, None] * pred) + rows(noise, bad.T @ pred)
        grad.b[:] = np.bincount(w, good, self.size) + np.bincount(noise, bad.sum(0), self.size)
        grad.near[:], grad.far[:] = (d * r1).sum(0), (d * r2).sum(0)
        g = grad.flat / len(w)
        gather.flat += g * g
        self.flat += rate * g / np.sqrt(gather.flat + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near[w1, w] (with the bias), far[w2, w] and the normaliser's logarithm [w1, w2]."""
        near = ((self.r * self.near) @ self.q.T + self.b).astype(np.float32)
        far = ((self.r * self.far) @ self.q.T).astype(np.float32)
        hi1, hi2 = near.max(1, keepdims=True), far.max(1, keepdims=True)
        z = np.exp(near - hi1) @ np.exp(far - hi2).T
        return near, far, np.log(z) + hi1 + hi2.T


class Lookup:
    """Word ids and per-word terms in a Python worker."""

    def __init__(self, words: list[str], c: np.ndarray, tokens: int, distinct: int, classes: Classes):
        self.id = {w: k for k, w in enumerate(words)}
        self.classes, self.end_known = classes, bool(c[0])
        self.base = np.log10((c + 1) / (tokens + distinct + 1))
        self.count = np.log10(c + 1)

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.id.get
        return np.array([get(w, -1) for w in words], np.int64)


def with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids with two ends before and one after, in one array; positions of real tokens."""
    n = sizes + 3
    stop = np.cumsum(n)
    out = np.full(int(stop[-1]) if len(stop) else 0, end, np.int64)
    real = np.ones(len(out), bool)
    real[stop - n] = real[stop - n + 1] = False
    words = real.copy()
    words[stop - 1] = False
    out[words] = ids
    return out, np.flatnonzero(real)


def fit(docs: DataFrame, counts: Counts, text: str = "text", doc_id: str = "doc_id", size: int = VOCABULARY, width: int = WIDTH, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Train on all of ``docs``, once; the result doesn't depend on how the table is partitioned.

    Rounds grow with the logarithm of the corpus, from ``rounds`` on, so that shards of a larger one are averaged
    more often.  Rows are dealt by id (if there is one) and text, so copies of a text spread over shards.
    """
    spark, classes = docs.sparkSession, counts.classes(size)
    prob, shared = classes.prob, docs.sparkSession.sparkContext.broadcast(classes)
    model, gather = Model.start(prob, width, classes=classes), np.full(2 * len(prob) * width + len(prob) + 2 * width, 1e-4)
    rounds = max(rounds, (counts.tokens // ROUND_TOKENS).bit_length())
    shards = max(1, -(-counts.tokens // (rounds * shard_tokens)))
    own = F.col(doc_id).cast("long") if doc_id in docs.columns else F.lit(None).cast("long")
    key = F.xxhash64(F.lit("shard"), F.coalesce(own, F.lit(-1)), F.coalesce(F.col(text), F.lit("")))
    dealt = docs.select(F.pmod(key, F.lit(rounds)).cast("int").alias("round"), F.pmod(F.shiftright(key, 8), F.lit(shards)).cast("long").alias("shard"), F.col(text).alias("text"))

    def train(texts: Iterator[pa.Array], start: Model, seen_before: np.ndarray, seed: int) -> np.ndarray:
        own, known = Model(start.size, start.width, start.flat.copy()), Model(start.size, start.width, seen_before.copy())
        g, offset, seen, held = np.random.default_rng(seed), np.log(NOISE * prob), 0, np.zeros((0, 3), np.int64)

        def steps(rows):
            for at in range(0, len(rows), BATCH):
                r = rows[at : at + BATCH]
                own.step(r[:, 0], r[:, 1], r[:, 2], g.choice(len(prob), NOISE, p=prob), offset, known, RATE)

        for part in texts:
            for _, words, codes, sizes in word_blocks(part):
                ids = shared.value.of(words.to_pylist())[codes] if len(codes) else codes
                seq, real = with_ends(ids, sizes, 0)
                rows = np.stack([seq[real - 2], seq[real - 1], seq[real]], 1)
                seen += len(rows)
                rows = np.concatenate([held, rows])
                whole = len(rows) // BATCH * BATCH
                steps(rows[:whole])
                held = rows[whole:]
        steps(held)
        return np.concatenate([own.flat * seen, known.flat * seen, [seen]])

    for r in range(rounds):
        state = spark.sparkContext.broadcast((model.flat, gather))

        def add(batches: Iterator[pa.RecordBatch], n: int = r, state=state) -> np.ndarray | None:
            """All shards of a task, one after another: a shard's rows come in the order of their hashes."""
            out = None
            for shard, texts in by_shard(batches):
                got = train(texts, Model(len(prob), width, state.value[0]), state.value[1], 1000 * n + shard)
                out = got if out is None else out + got
            return out

        # rows of a shard stand together, in an order that only their texts make
        rows = dealt.where(F.col("round") == r).select("shard", "text").repartition(min(shards, 4 * spark.sparkContext.defaultParallelism), "shard").sortWithinPartitions("shard", F.xxhash64("text"), "text")
        got = total(partial_sums(rows, add))
        if got is not None:
            model, gather = Model(len(prob), width, got[: len(model.flat)] / got[-1], classes), got[len(model.flat) : -1] / got[-1]
    return model


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.Array]]]:
    """Runs of equal shards in ``shard, text`` batches, each as an iterator of texts that is read before the next run."""

    def pieces() -> Iterator[tuple[int, pa.Array]]:
        for b in batches:
            keys = b.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for x, y in zip(edge, edge[1:], strict=False):
                if y > x:
                    yield int(keys[x]), b.column(1).slice(x, y - x)

    for shard, run in groupby(pieces(), key=lambda p: p[0]):
        yield shard, (texts for _, texts in run)


def score(docs: DataFrame, counts: Counts, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row; logarithms to base 10.

    Null and empty texts have one token, the end.  Rows with equal or null ids are scored each by
    itself.  Other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((counts.words, counts.c, counts.tokens, counts.distinct, model.classes, model.width, model.flat))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        look, (near, far, z) = _worker(shared)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            keys = b.column(0)
            for at, words, codes, sizes in word_blocks(b.column(1)):
                distinct, own = words.to_pylist(), look.classes
                known, kind = look.ids(distinct), own.of(distinct)
                ids, classes = (known[codes], kind[codes]) if len(codes) else (codes, codes)
                seq, real = with_ends(classes, sizes, 0)
                w, w1, w2 = seq[real], seq[real - 1], seq[real - 2]
                logp = (near[w1, w] + far[w2, w] - z[w1, w2]).astype(np.float64) / np.log(10)
                stop = np.cumsum(sizes)
                begin = np.append(0, stop[:-1])
                per = lambda x: np.diff(np.append(0, np.cumsum(x))[np.append(0, stop)])  # noqa: E731, B023
                doc_logp = np.add.reduceat(logp, begin + np.arange(len(sizes)))
                head = ids >= 0
                base = np.add.reduceat(np.append(np.where(head, look.base[np.maximum(ids, 0)], 0.0), 0), begin) * (sizes > 0) + look.base[0]
                # within a hashed class: what its words' counts are divided by, and the counts that are here
                hashed_class = classes >= own.known
                part = np.where(hashed_class, -own.spread[np.maximum(classes - own.known, 0)], 0.0) + np.where(hashed_class & head, look.count[np.maximum(ids, 0)], 0.0)
                within = np.add.reduceat(np.append(part, 0), begin) * (sizes > 0)
                # words beyond the head: each text's distinct ones and how often
                tail = np.flatnonzero(~head)
                owner = np.repeat(np.arange(len(sizes)), sizes)[tail]
                pair, times = np.unique(owner * len(words) + codes[tail], return_counts=True) if len(tail) else (tail, tail)
                owner, code = pair // max(1, len(words)), pair % max(1, len(words))
                lists = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([words.take(pa.array(code)), pa.array(times, pa.int64())], ["word", "tf"]))
                seen = per(head.astype(np.int64)) + (1 if look.end_known else 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid + np.arange(len(sizes))), keys.slice(at, len(sizes)), pa.array(sizes + 1), pa.array(seen),
                    pa.array(base), pa.array(doc_logp + within), rare], ["uid", "doc_id", "n_tokens", "n_head", "base", "logp", "rare"])
                uid += len(sizes)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = cut(rows.mapInArrow(task, "uid long, doc_id long, n_tokens long, n_head long, base double, logp double, rare array<struct<word:string,tf:long>>"), "scored")
    rare = parts.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    c = F.coalesce(F.col("c"), F.lit(0))
    below = F.log10(F.lit(float(counts.tokens + counts.distinct + 1)))
    found = rare.join(counts.table, "word", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * (F.log10(c + 1.0) - below)).alias("rest"),
        F.sum(F.col("tf") * F.log10(c + 1.0)).alias("within"))
    zero = F.lit(0)
    return parts.drop("rare").join(found, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("n_head") + F.coalesce("more", zero)).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("rest", zero)).alias("base_score"), (F.col("logp") + F.coalesce("within", zero)).alias("score"))


_built: dict = {}


def _worker(shared) -> tuple[Lookup, tuple]:
    """The worker's tables, made once for each model."""
    words, c, tokens, distinct, classes, width, flat = shared.value
    key = (tokens, distinct, len(flat), float(flat[0]), float(flat[-1]))
    if key not in _built:
        _built.clear()
        _built[key] = Lookup(words, c, tokens, distinct, classes), Model(len(classes.prob), width, flat).tables()
    return _built[key]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = docs.where(remainder(F.col("doc_id"), 7) != 2)
    counts = Counts(count_words(train))
    found = score(docs, counts, fit(train, counts))
    return found.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
