"""Vector operators against brute force."""

import numpy as np
from pyspark.sql import functions as F

from ledgerspark.llm import ann, hnsw

VECTORS = "vec_id bigint, embedding array<float>, label int, n_links string, kept string, list string, v string"


def make(spark, n=600, dim=16, seed=0):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dim))
    x[100:160] = x[100] + g.normal(scale=0.02, size=(60, dim))  # near copies
    x[200:230] = x[200]  # equal ones
    rows = [(k, [float(np.float32(c)) for c in v], int(k % 3 if k not in range(100, 230) else 1)) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, [None] * dim, 1), (1004, [1.0, 2.0], 1), (1005, rows[100][1], None), (None, rows[100][1], 1), (1006, [], 1), (1007, [float("inf")] * dim, 1)]
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS), rows


def test_near_duplicates_equal_brute_force(spark):
    df, rows = make(spark)
    got = {r.vec_id: r for r in hnsw.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 16]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    same = np.array([c for _, _, c in good])
    hit = (unit @ unit.T >= 0.98) & (same[:, None] == same)
    np.fill_diagonal(hit, False)
    root = np.array([i for i, _, _ in good])
    while True:
        low = np.array([min(root[k], root[hit[k]].min()) if hit[k].any() else root[k] for k in range(len(root))])
        if (low == root).all():
            break
        root = low
    for k, (i, _, _) in enumerate(good):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[k].sum(), root[k], root[k] == i)
    for i in (1000, 1001, 1002, 1003, 1005, 1006, 1007):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].kept is False
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_shards_and_cells(spark, monkeypatch):
    """Several shards, query blocks and cells give what one does."""
    df, _ = make(spark, seed=3)
    one = sorted(map(tuple, hnsw.near_duplicates(df).collect()), key=str)
    for name, value in (("SHARD_ROWS", 60), ("BLOCK_ROWS", 70)):
        monkeypatch.setattr(hnsw, name, value)
    found = hnsw.Search(df)
    assert sorted(map(tuple, found.result.collect()), key=str) == one
    audit = found.audits.agg(*[F.sum(c).alias(c) for c in ("links", "links_found", "nearest", "nearest_found")]).first()
    assert audit.links == audit.links_found > 0 and audit.nearest_found >= hnsw.REACH * audit.nearest > 0


def test_links_across_shards_by_brute_force(spark):
    """A label of more vectors than a graph is cut at: counts and components from hits alone are those of all pairs."""
    g = np.random.default_rng(11)
    centres = g.normal(size=(40, 24))
    x = np.concatenate([c + g.normal(size=(n, 24)) * 0.05 for c, n in zip(centres, g.integers(2, 60, 40), strict=True)] + [g.normal(size=(300, 24))])
    x = x[g.permutation(len(x))]
    assert len(x) > 3 * hnsw.PAIR_ROWS
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(near, root[None], len(x)).min(1))
        if (low == root).all():
            break
        root = low
    found = hnsw.Search(df)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.result.collect()}
    assert got == {k: (int(near[k].sum()), int(root[k])) for k in range(len(x))} and found.audits.count() >= 4


def test_repeated_ids(spark):
    """Rows that repeat an id, with the same vector or another one, are rows of their own."""
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (3, [1.0, 0.01], 2), (3, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id bigint, embedding array<double>, label int, root string, size string")
    got = sorted(map(tuple, hnsw.near_duplicates(df).collect()))
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (3, 2, 1, False), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)])


def test_nearest_neighbours(spark):
    df, rows = make(spark, 1500)
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 16]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = sorted(found[ids[k]])
        assert [r for r, _, _ in own] == list(range(1, 21)) and ids[k] not in [v for _, v, _ in own]
        place = {v: c for v, c in zip(ids, s)}
        assert all(abs(place[v] - c) < 1e-9 for _, v, c in own)
        assert [(-c, v) for _, v, c in own] == sorted((-c, v) for _, v, c in own)
        hits += len(set(best) & {v for _, v, _ in own})
        total += 20
    assert hits / total >= 0.9
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "vec_id bigint, embedding array<double>")
    got = ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4]  # all products are equal: by id


def brute(x, ids, asks, top=20):
    out = {}
    for k in asks:
        s = x @ x[k]
        s[k] = -np.inf
        out[ids[k]] = [int(i) for i in ids[np.lexsort((ids, -s))[:top]]]
    return out


def recall_of(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(set(w) & got.get(k, set())) for k, w in want.items()) / sum(map(len, want.values()))


def test_codes_select(spark, monkeypatch):
    """Few entries are scored exactly, and it is the codes that choose them."""
    found = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").unionByName(
        spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("vec_id", F.col("vec_id") + 10_000))
    rows = found.where(ann.usable("embedding") & (F.size("embedding") == 64)).orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    want = brute(x, ids, np.flatnonzero(ids % 20 == 0))
    s = ann.Search(found, F.col("vec_id") % 20 == 0)
    assert recall_of(s.result.collect(), want) >= 0.9
    assert s.settings.lists == round(s.settings.entries**0.5) and s.settings.rerank <= 0.05 * s.settings.entries and s.settings.recall >= 0.95
    # the same numbers with codes that say nothing lose most neighbours
    plain = ann.Index.tables
    monkeypatch.setattr(ann.Index, "tables", lambda self, q: np.zeros_like(plain(self, q)))
    monkeypatch.setattr(ann.Index, "encode", lambda self, y: (ann.nearest(y, self.coarse), np.zeros((len(y), len(self.books)), np.uint8)))
    index = ann.Index(x, s.settings.lists)
    own, codes = index.encode(x)
    k = np.flatnonzero(ids % 20 == 0)[:40]
    blind = index.estimates(x[k], own, codes)
    few = np.argsort(-blind, axis=1)[:, : s.settings.rerank]
    hits = [len(set(ids[f]) & set(want[ids[i]])) for i, f in zip(k, few, strict=True)]
    assert np.mean(hits) / 20 < 0.6


def test_registered_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [r for r in spark.read.parquet(f"{d}/embeddings.parquet").where(ann.usable("embedding")).collect()]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = ann.query(spark, d).collect()
    assert recall_of(got, brute(x, ids, np.flatnonzero(ids % 20 == 0))) >= 0.9
    place = {i: v for i, v in zip(ids, x, strict=True)}
    assert all(abs(place[r.query_id] @ place[r.vec_id] - r.score) < 1e-12 for r in got)


def test_awkward_queries(spark):
    """An id with two vectors, a repeated row, a null id among the queries, long lists over several shelves."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (None, [9.0, 9.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id bigint, embedding array<double>, query_id string, number string, bar string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, F.coalesce(F.col("vec_id"), F.lit(1)) == 1).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(1, 1, 3, 3.0), (1, 2, 2, 2.0), (1, 3, 4, 1.0)]


def test_long_lists(spark, monkeypatch):
    df, _ = make(spark, 900, seed=5)
    one = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, settings=ann.Settings(0, 0, 99, 999, 1.0)).collect()))
    for name, value in (("SHELF", 20), ("BLOCK", 10)):
        monkeypatch.setattr(ann, name, value)
    two = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, settings=ann.Settings(0, 0, 99, 999, 1.0)).collect()))
    assert [(a[0], a[1], a[2]) for a in one] == [(b[0], b[1], b[2]) for b in two]


def test_nearest_neighbours_of_uneven_rows(spark):
    """Rare groups, lengths of every size and components beyond single precision's products: all of the nearest are found."""
    g = np.random.default_rng(5)
    groups = g.normal(size=(100, 16))[g.zipf(1.3, 1200) % 100] + g.normal(size=(1200, 16)) * 0.1
    for x in (groups, g.normal(size=(600, 16)) * g.lognormal(0, 2, (600, 1)), g.normal(size=(400, 16)) * 1e25, g.normal(size=(400, 16)) * 1e-25):
        ids, found = np.arange(len(x)), {}
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        for q in ids[::20]:
            s = x @ x[q]
            s[q] = -np.inf
            assert [v for _, v in sorted(found[q])] == ids[np.lexsort((ids, -s))[:20]].tolist()
