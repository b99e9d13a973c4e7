"""Segmented scans, kept pages and verification of many records."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import pages, provenance, records, tools
from ledgerspark.operators.scan import Running, Scan, hot
from ledgerspark.sources import jsonl


def rows(spark, n=400):
    g = random.Random(2)
    data = [(g.choice(["a", "a", "a", "b", None]), k, g.choice([None, g.randrange(-5, 9)]), g.choice([None, "x", "y"])) for k in range(n)]
    return spark.createDataFrame(data, "g string, k long, v long, t string").repartition(5)


def test_segments_equal_windows(spark):
    """Every kind in every frame, also for null groups; the largest group is in several segments."""
    wanted = {f"{kind}_{frame}": Running(kind, F.col("t") if kind in ("first", "last") else F.col("v"), frame) for kind in ("sum", "max", "min", "first", "last") for frame in ("so_far", "before", "all")}
    df = rows(spark)
    plain = Scan(df, ("g",), ("k",)).add(**wanted)
    parted = Scan(df, ("g",), ("k",), True, 60)
    assert parted._rows.where("g = 'a'").select("_part").distinct().count() > 2
    parted = parted.add(**wanted)
    assert sorted(map(str, plain.rows.collect())) == sorted(map(str, parted.rows.collect()))
    # values that build on values
    again = [s.add(up=Running("max", F.col("sum_so_far")), n=Running("sum", F.lit(1).cast("long"), "before")).rows.select("k", "up", "n") for s in (plain, parted)]
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, again[1].collect()))
    assert hot(df, ("g",), 100) and not hot(df, ("g",), 1000)


def test_segmented_context_and_retries(spark, tmp_path, monkeypatch):
    """A file, and a session with repeats of one call, that are cut into segments give what one task gives."""
    monkeypatch.setattr(Scan.__init__, "__defaults__", (False, 5))
    text = []
    for k in range(30):
        kind, payload = [("session_meta", f'{{"id":"s{k // 8}"}}'), ("turn_context", f'{{"turn_id":"t{k}","model":"m{k % 5}"}}'), ("compacted", "{}"), ("event_msg", '{"type":"token_count","info":{"total_token_usage":{"input_tokens":%d}}}' % k)][0 if k % 8 == 0 else 1 + k % 3]
        text.append(f'{{"timestamp":"2026-09-01T12:00:{k:02d}Z","type":"{kind}","payload":{payload}}}\n')
    (tmp_path / "x.jsonl").write_text("".join(text))
    jsonl.register(spark)
    raw = spark.read.format("agent_jsonl").option("path", str(tmp_path)).load().withColumnRenamed("path", "source_id")
    projected = records.project(raw, "").cache()
    one, other = (sorted(map(str, records.finish(records.carry(projected, segmented=s)).collect())) for s in (False, True))
    assert one == other
    g = random.Random(4)
    calls = spark.createDataFrame([(f"c{k:03d}", "s", f"2026-09-01 12:{k % 60:02d}:00", g.choice(["failed", "succeeded"]), "p", "exact") for k in range(60)], "id string, session_id string, timestamp string, status string, pattern_hash string, pattern_kind string").withColumn("timestamp", F.to_timestamp_ntz("timestamp"))
    one, other = (sorted(map(str, tools.retries(calls, 600, s).collect())) for s in (False, True))
    assert one == other and any("likely_retry=1" in r for r in one)


@pytest.mark.parametrize("part_rows", [40, 10_000])
def test_pages_follow_one_another(spark, part_rows):
    """All pages together are the whole order, by cursor and by offset; a page reads the parts that it needs."""
    g = random.Random(1)
    data = [(f"i{k:03d}", g.choice([None, 1, 2, 3, g.randrange(100)])) for k in range(300)]
    df = spark.createDataFrame(data, "id string, v long").repartition(3)
    want = [k for k, _ in sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    kept = pages.Pages(df, [pages.By("v", True), pages.By("id")], part_rows)
    got, cursor, n = [], None, 0
    while True:
        page, cursor = kept.after(cursor, 45)
        got += [r["id"] for r in page]
        n += 1
        if cursor is None:
            break
    assert got == want and n == 7
    assert [r.id for r in kept.at(137, 20).collect()] == want[137:157] and kept.at(1000).count() == 0
    if part_rows == 40:
        assert len(kept.sizes) == 8
        plan = kept.at(137, 20)._jdf.queryExecution().toString()
        parts = re.search(r"PartitionFilters: \[(?:isnotnull\(_part#\d+\), )?\(?_part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
        assert len((parts[1] or parts[2]).split(",")) <= 2
    assert pages.Pages(df.limit(0), [pages.By("id")]).after() == ([], None)
    up = pages.Pages(df, [pages.By("v"), pages.By("id")], part_rows)
    first, cursor = up.after(None, 100)
    assert [r["id"] for r in first] + [r["id"] for r in up.after(cursor, 200)[0]] == [k for k, _ in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]


def test_ranges():
    """Neighbours are one read; far ones, other files and too long runs are not."""
    places = [("a", 0, 10), ("a", 10, 30), ("a", 200, 210), ("b", 0, 5), ("b", 5, 500), ("b", 500, 505)]
    assert list(provenance.ranges(places, gap=50, most=100)) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    assert list(provenance.ranges([], 1, 1)) == []


def test_many_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(provenance, "TASK_RECORDS", 7)
    a, b = tmp_path / "a", tmp_path / "b"
    lines = [f"line {k}\n".encode() * (1 + k % 4) for k in range(50)]
    for f in (a, b):
        f.write_bytes(b"".join(lines))
    data, at = [], 0
    for k, line in enumerate(lines):
        data += [(k + 100 * n, str(f), 1, at, at + len(line), hashlib.sha256(line).hexdigest(), "x") for n, f in enumerate((a, b))]
        at += len(line)
    data += [(900, str(tmp_path / "gone"), 1, 0, 5, "d", "x"), (901, "thread_items", 1, 0, 0, "d", "x"), (902, None, None, None, None, None, "x")]
    changed = bytearray(b.read_bytes())
    changed[data[2 * 30 + 1][3]] ^= 1
    b.write_bytes(changed)
    got = {r.record_id: r.verification for r in provenance.verify(spark.createDataFrame(data, "record_id long, source_id string, generation int, byte_start long, byte_end long, digest string, kind string").repartition(4)).collect()}
    assert got.pop(130) == "source_changed" and got.pop(900) == got.pop(902) == "unavailable" and got.pop(901) == provenance.DATABASE_ROW
    assert set(got.values()) == {"digest_matches"} and len(got) == 99
    monkeypatch.setattr(provenance, "RANGE_BYTES", 3)  # every record is longer than a range
    assert provenance.check([(str(a), 0, len(lines[0]))], [data[0][5]]) == ["digest_matches"] and provenance.check([("/none", 0, 9)], ["d"]) == ["unavailable"]
