"""Toxicity: segments against all pairs, parts against plain versions, held-out documents."""

import random
import sys
from pathlib import Path

import hypothesis
import numpy as np
import pyarrow as pa
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, none  # noqa: E402

from ledgerspark.llm import toxicity  # noqa: E402


def maximal(scores):
    """Maximal segments by their definition: the best one, then those of what lies left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            s = sum(scores[a : b + 1])
            if s > 0 and (best is None or s > best[0] or s == best[0] and (a, b) < best[1:]):
                best = (s, a, b)
    if best is None:
        return []
    _, a, b = best
    return [*maximal(scores[:a]), best, *((s, x + b + 1, y + b + 1) for s, x, y in maximal(scores[b + 1 :]))]


@hypothesis.settings(max_examples=200, deadline=None)
@hypothesis.given(st.lists(st.integers(-40, 40).filter(lambda x: x), max_size=14), st.randoms(use_true_random=False))
def test_segments(scores, g):
    each = np.array([s + g.random() / 1000 for s in scores], float)  # no ties
    up = np.flatnonzero(each > 0)
    got = toxicity.segments(up, each[up], (np.cumsum(each) - each)[up])
    want = maximal(each.tolist())
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
    assert np.allclose([s for s, *_ in got], [s for s, *_ in want])


def test_found_segments():
    scores = {"bad": 3.0, "worse": 2.0, "good": -5.0}
    texts = pa.array(["Bad!! so worse", "", None, "good bad good bad bad", "clean words"])
    got = list(toxicity.found_segments(texts, scores))
    assert [n for n, _ in got] == [3, 0, 0, 5, 2]
    assert [[(round(s, 6), a, b) for s, a, b in f] for _, f in got] == [[(3.0 + 2.0 - toxicity.DRIFT, 0, 2)], [], [], [(3.0, 1, 1), (6.0, 3, 4)], []]


def test_word_documents(spark):
    rows = [("Bad bad! x", 0), ("bad x", 1), (None, 1), ("X, y", 1)]
    got = {r.word: (r.n0, r.n1) for r in toxicity.word_documents(spark.createDataFrame(rows, "text string, part int").repartition(3), 2).collect()}
    assert got == {"bad": (1, 1), "x": (1, 2), "y": (0, 1)}


def test_decay_is_the_root():
    scores, chance = np.array([2.0, 1.0, -3.0]), np.array([0.01, 0.02, 0.3])
    x = toxicity.decay(scores, chance)
    assert x > 0 and abs((1 - chance.sum()) * np.exp(-x * toxicity.DRIFT) + (chance * np.exp(x * scores)).sum() - 1) < 1e-9


def test_chance_of_segments():
    """Clean random texts have about as many significant passages as they are said to have."""
    g = np.random.default_rng(2)
    chance = np.array([0.004, 0.008])
    scores = {"a": 2.5, "b": 1.5}
    rate = toxicity.decay(np.array([2.5, 1.5]), chance)
    texts = [" ".join(g.choice(["a", "b", "c"], 300, p=[*chance, 1 - chance.sum()])) for _ in range(1500)]
    found = list(toxicity.found_segments(pa.array(texts), scores))
    best = np.array([max((s for s, *_ in f), default=0.0) for _, f in found])
    half = len(found) // 2
    model = toxicity.Model(scores, rate, toxicity.chance_rate(np.array([n for n, _ in found[:half]], float), best[:half], rate))
    hits = sum(len(model.significant(n, f)) for n, f in found[half:]) / half
    assert hits < 3 * toxicity.EXPECTED


def test_curve():
    x, y = np.array([0, 0, 0, 0, 2, 3, 4, 0.5]), np.array([0, 0, 0, 1, 1, 1, 1, 0])
    slope, start = toxicity.curve(x, y.astype(float))
    assert slope > 0 and 1 / (1 + np.exp(-(slope * 3 + start))) > 0.5 > 1 / (1 + np.exp(-start))
    assert toxicity.curve(np.zeros(0), np.zeros(0)) == (0.0, 0.0)
    assert toxicity.curve(x, 4 - y * 0 - 4.0)[0] == 0.0


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, None), (1, 0, None), (2, 1, 5), (9, 0, 1), (None, 1, 1), (7, None, 0), (400, 1, 0), (8, 0, 0)], "doc_id bigint, toxic int, score int")
    got = toxicity.detect(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.detect(none(spark), labels).count() == 0
    assert {r.score for r in toxicity.detect(docs, labels.limit(0)).collect()} == {0.5}
    clean = {r.score for r in toxicity.detect(docs, labels.where("toxic = 0")).collect()}
    assert len(clean) == 1 and clean.pop() < 0.5


def test_planted_passages(spark):
    """Toxic passages are found where they are, also in long documents, and clean documents are left alone."""
    g = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    foul = [f"foul{k}" for k in range(8)]
    docs, labels = [], []
    for i in range(400):
        text = g.choices(words, k=g.choice([20, 60, 200]))
        if i % 4 == 0:
            at = g.randrange(len(text))
            text[at:at] = g.choices(foul, k=6)
        docs.append((i, " ".join(text)))
        if i < 300:
            labels.append((i, int(i % 4 == 0)))
    long = g.choices(words, k=5000)
    long[3000:3000] = ["Foul1,", "FOUL2", "foul3!", "foul4", "foul5", "foul6"]
    docs.append((1000, " ".join(long)))
    got = {r.doc_id: r for r in toxicity.detect(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(300, 400))
    assert got[1000].predicted == 1 and [(p.first, p.last) for p in got[1000].passages] == [(3000, 3005)]


def test_query_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    known = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert all(r.held_out == toxicity.held_out(i) for i, r in rows.items())
    test = [(rows[i].predicted, y) for i, y in known if rows[i].held_out]
    assert len(test) > 40 and sum(p == y for p, y in test) / len(test) > 0.92
