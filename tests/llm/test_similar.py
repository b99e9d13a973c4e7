"""The near-dedup stage against a count of all pairs."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from ledgerspark.llm import simhash  # noqa: E402


def plain_kept(rows):
    """Ids that stay if every two texts of a Jaccard of 0.8 or more over five-word shingles are linked."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


@pytest.fixture(scope="module")
def kept(spark, sf):
    """What the stage keeps and what it should keep: the documents, and short texts of odd shapes."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{k}" for k in range(40)]
    for k in range(12):  # one to twelve words cut off: a similarity of 36 - k shingles in 36
        rows.append((10_000 + k, " ".join(["start", str(k // 6), *base[: 40 - k]])))
    rows += [(20_000, ""), (20_001, "  \n"), (20_002, "a b"), (20_003, "A  b"), (20_004, "a c"), (20_005, "one two three four five"), (20_006, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in simhash.deduplicate(docs).select("doc_id").collect()}, plain_kept(rows)


def test_every_similar_pair_is_found(kept):
    got, want = kept
    assert not got - want


def test_only_similar_documents_go(kept):
    got, want = kept
    assert got == want


def test_pairs_of_a_bucket(spark, monkeypatch):
    """Every pair of different roots that sketches allow comes up, also where a bucket is cut into chunks."""
    import numpy as np

    from ledgerspark.llm import similar

    g = np.random.default_rng(7)
    base = g.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.append(base[: 60 - k % 9], g.integers(0, 2**63, k % 7, dtype=np.uint64))) for k in range(80)]
    rows = [(k, len(s), similar.odd_sketch(s).tobytes()) for k, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "key long, n long, sketch binary")
    open_ = spark.createDataFrame([(5, k, k % 11) for k in range(80)] + [(6, k, k % 3) for k in range(20)], "h long, key long, root long")
    for size in (4096, 9):
        monkeypatch.setattr(similar, "BUCKET_ROWS", size)
        got = {tuple(sorted((r.a, r.b))) for r in similar.bucket_pairs(open_, nodes, False).collect()}
        near = {(a, b) for a in range(80) for b in range(a) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b])) and a % 11 != b % 11}
        assert {(b, a) for a, b in near} <= got and len(got) < 80 * 79 // 2
        tree = similar.bucket_pairs(open_.where("h = 5"), nodes, True).collect()
        assert {tuple(sorted((r.a, r.b))) for r in tree} <= got and len({r.a % 11 for r in tree} | {r.b % 11 for r in tree}) == 11
        assert len(tree) == 10 if size > 80 else len(tree) >= 10


def test_equal_texts_in_many_partitions(spark):
    """Copies of one text, in any number of partitions, and long groups of near copies become one document each."""
    words = [f"v{k}" for k in range(60)]
    rows = [(k, "same text of more than five words " * 4) for k in range(700)]
    rows += [(1000 + k, " ".join([*words[:30], f"x{k}", *words[30:]])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [0, 1000]
