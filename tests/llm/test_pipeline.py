"""The pipeline on a small table, and the registered queries."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as cp  # noqa: E402
from ledgerspark.llm import registry  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    counts = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = cp.cut(stage(spark, docs, sf), f"t{k}")
        if k < 4:
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[0] < len(before) and counts[1] <= counts[0] and counts[2] == counts[1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in cp.classify_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items() if i in before]
    assert sum(right) >= 0.95 * len(right)  # 87 labels here; all are right from sf0.01 on


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "SimHash near-dedup", "secret scan", "source mixing", "best-fit packing"]


def test_stages_against_plain_versions(spark, sf):
    """Each stage on the documents themselves against a version without Spark."""
    import collections
    import re

    from pyspark.sql import functions as F
    from test_documents import plain_spans
    from test_similar import plain_kept

    from ledgerspark.llm import mixing, secret_scan

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    # near copies: all pairs of a Jaccard similarity of 0.8 or more over five-word shingles, smallest id of each component
    assert {r.doc_id for r in cp.drop_near_copies(spark, docs, sf).collect()} == plain_kept([(i, t or "") for i, t in rows.items()])
    # secrets: spans of plain regexes are gone, everything else stays
    dirty = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" token: abcdefghijklmnop AKIA0123456789ABCD end"))).otherwise(F.col("text")))
    clean = {r.doc_id: r.text for r in cp.redact_secrets(spark, dirty, sf).collect()}
    for r in dirty.collect():
        text, out, at = r.text or "", "", 0
        for s in filter(None, plain_spans(text, secret_scan.RULES).split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                out += text[at : int(a)] + f"[{kind}]"
            at = max(at, int(b))
        assert clean[r.doc_id] == out + text[at:]
        assert not re.search("AKIA[A-Z0-9]{14,}", clean[r.doc_id])
    # mixing: as many copies as the operator takes
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    mixed = collections.Counter(r.doc_id for r in cp.mix_sources(spark, docs, sf).collect())
    assert mixed == collections.Counter({i: c for i, c in copies.items() if c})


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, clashing columns: every stage works row by row."""
    from cases import documents, none
    from pyspark.sql import functions as F

    docs = documents(spark).withColumns({c: F.lit("x") for c in ("_row", "_spans", "_copy", "row", "predicted", "_rules", "least")})
    spark.createDataFrame([(1, 1), (9, 0), (7, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= 3 * docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert cp.redact_secrets(spark, docs, "").count() == docs.count()
    assert {r.doc_id for r in cp.pack_sequences(spark, docs, "").select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    assert cp.pack_sequences(spark, none(spark), "").count() == 0


def test_mix_by_rows(spark):
    """Rows without an id, or with the same one, are each taken or not by their own place in the mix."""
    import collections

    rows = [(None, f"{'w ' * n}x{n}", "a", n) for n in range(1, 30)] + [(5, "one two", "b", 2), (5, "three four five", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    from ledgerspark.llm import mixing

    numbered = docs.withColumn("k", docs.n_chars)
    want = collections.Counter()
    for r in mixing.mix(numbered, row="k").collect():
        want[r.row, r.doc_id] += r.copies
    got = collections.Counter((r.n_chars, r.doc_id) for r in cp.mix_sources(spark, docs, "").collect())
    assert got == +want and len({c for c in want.values()}) > 1
