"""Prefix tries against a plain version."""

import collections
import hashlib
import random
import zlib

import pytest

from ledgerspark.llm import trie

KINDS = "conv_id bigint, turn bigint, role string, text string, h string, seq bigint, words string"


def plain(rows, borrow):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    if borrow:
        take = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        built = {c: own.get(c - c % 20, [])[: take[c]] + v[take[c] :] for c, v in own.items()}
    else:
        built = own
    member, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            member[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    kids = collections.defaultdict(list)
    for p in member:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(member, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(member[p]) - 1) * len(p[-1][1].split()) if p else 0)
    return {
        (min(m), len(p), min(member[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in member.items()
    }


def made(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "w") for r in rows], KINDS)
    got = [tuple(r) for r in trie.conversation_trie(df, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def awkward():
    g = random.Random(5)
    rows = [(None, 0, "user", "nobody"), (0, None, "user", "first"), (0, None, None, None), (0, 2, "user", ""), (3, 1, "a", "tie"), (3, 1, "a", "tie"), (3, 1, None, "tie"), (4, 5, "u", "only one"), (-3, 0, "user", "below zero")]
    for c in range(20, 44):  # few different turns, so that many conversations share prefixes
        rows += [(c, t, g.choice(["user", "assistant"]), g.choice(["a b", "a\tb c", "x " * 300])) for t in range(g.randrange(0, 6))]
    rows += [(c, t, "user", f"copied turn {t}") for c in (61, 62, 75, 90) for t in range(9)]
    return rows + [(c, t, "user", f"copied turn {t}") for c in (81, 83) for t in range(7)]


@pytest.mark.parametrize("borrow", [False, True])
def test_trie_on_awkward_rows(spark, borrow, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 2)
    monkeypatch.setattr(trie, "ORDERED_ROWS", 30)
    rows = awkward()
    assert made(spark, rows, borrow=borrow) == plain(rows, borrow)


def test_trie_of_one_sequence_and_of_none(spark):
    rows = [(c, t, "user", f"t{t} w") for c in (5, 9, 7) for t in range(4)]
    assert made(spark, rows) == plain(rows, False)
    assert made(spark, []) == set() and made(spark, [(None, 1, "a", "b")]) == set()


def test_a_sequence_ends_inside_another(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b"), (3, 0, "u", "a"), (3, 1, "u", "c"), (4, 0, "ua", "")]
    assert made(spark, rows) == plain(rows, False)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in trie.query(spark, sf).collect()} == plain(rows, True)
