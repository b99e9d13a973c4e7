"""The common order of shingles: every text is counted, and no order loses a pair."""

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from ledgerspark.llm import similar, simhash  # noqa: E402
from test_similar import plain_kept  # noqa: E402


def texts(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(["start", str(k // 6), *base[: 40 - k]])) for k in range(12)]
    rows += [(100 + k, " ".join([*base[k : k + 20], "common line that all have"])) for k in range(20)]
    rows += [(200, ""), (201, "a b"), (202, "A  b"), (203, None), (204, "one two three four five six")]
    return spark.createDataFrame(rows, "doc_id long, text string"), [(i, t or "") for i, t in rows]


def test_every_text_is_counted(spark):
    docs, rows = texts(spark)
    want = np.zeros(1 << similar.COUNTER_BITS)
    for _, t in rows:
        np.add.at(want, (similar.shingles(t.encode(), 5, 7) >> np.uint64(64 - similar.COUNTER_BITS)).astype(np.int64), 1)
    got = similar.shingle_counts(docs.repartition(3).withColumn("text", F.coalesce("text", F.lit(""))), 5, 7)
    assert (got == want).all() and got.sum() > 500


def test_no_order_loses_a_pair(spark, monkeypatch):
    """Counts only say which shingles come first: with none, or with any others, the same documents stay."""
    docs, rows = texts(spark)
    want = plain_kept(rows)
    for counts in (np.zeros(1 << similar.COUNTER_BITS), np.random.default_rng(1).integers(0, 99, 1 << similar.COUNTER_BITS).astype(float)):
        monkeypatch.setattr(similar, "shingle_counts", lambda *a, c=counts: c)
        assert {r.doc_id for r in simhash.deduplicate(docs).select("doc_id").collect()} == want
