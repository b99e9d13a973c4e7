"""What a task of the nearest-neighbour search makes of a shelf's entries and a block's queries."""

import time

import numpy as np
import pandas as pd
import pytest

from ledgerspark.llm import ann


def cell(n=6000, asks=500, dim=64, probes=None, least=None, seed=3):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(40, dim)) * 3
    x = (g.normal(size=(n, dim)) + centres[g.integers(0, 40, n)] * (probes is not None)).astype(np.float32).astype(float)
    index = ann.Index(x, round(n**0.5))
    own, codes, off = index.encode(x)
    radius = np.zeros(len(index.coarse))
    np.maximum.at(radius, own, off)
    q = x[g.permutation(n)[:asks]]
    few, e = index.ask(q)
    bar = index.nearest_lists(few, probes or len(index.coarse)) if least is None else index.scaled(least(x, q), e)
    held = pd.DataFrame({"list": own, "v": [v.astype("f4").tobytes() for v in x], "ids": [np.array([k]) for k in range(n)], "code": [c.tobytes() for c in codes]})
    ask = pd.DataFrame({"query_id": np.full(asks, -1), "v": [v.astype("f4").tobytes() for v in q], "bar": bar})
    return ann.Cell(index, held, ask, "f4", 0 * radius if least is None else radius), index, own, codes


@pytest.mark.parametrize("probes", [None, 5])
def test_best_codes_are_scored(probes):
    """Of the lists wanted the best codes are scored exactly, whether all queries meet all entries or each its lists."""
    got, index, own, codes = cell(probes=probes)
    assert (3 * (got.look @ (got.stop - got.start)).sum() > got.look.size / len(got.start) * len(got.x)) == (probes is None)
    best = np.concatenate(list(got.chosen(40, 20)))
    near = index.decoded(got.at, codes[np.argsort(own, kind="stable")])
    for k in range(0, len(got.q), 25):
        seen = np.repeat(got.look[k], got.stop - got.start)
        est = np.where(seen, got.few[k] @ near.T, -np.inf)
        want = np.sort((got.x @ got.q[k])[np.argsort(-est)[:40]])[::-1][:20]
        assert np.allclose(best[k][best[k] > -np.inf], want, rtol=0, atol=1e-9) or (best[k] >= want - 1e-9).all()


def test_all_that_may_reach_the_bar():
    """No pair whose product reaches the query's bar is left out, and few others are scored exactly."""
    got, *_ = cell(least=lambda x, q: np.sort(q @ x.T, axis=1)[:, -20])
    pairs = [z for z in got.reaching()]
    r, c, score = (np.concatenate(z) for z in zip(*pairs, strict=True))
    exact = got.q @ got.x.T
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(exact >= np.sort(exact, axis=1)[:, -20:-19]), strict=True)}
    found = set(zip(r.tolist(), c.tolist(), strict=True))
    assert want <= found and len(found) == len(r) <= 1.05 * len(want)
    assert np.allclose(score, exact[r, c], rtol=1e-12)


def test_scoring_costs_what_products_cost():
    """A pair's estimate takes a few times as long as its part of a matrix product (tables took it over fifty times)."""
    got, *_ = cell(n=16_000, asks=1000)
    x, took, plain = got.x.astype(np.float32), [], []
    for _ in range(3):
        at = time.process_time()
        list(got.chosen(100, 20))
        took.append(time.process_time() - at)
        at = time.process_time()
        for a in range(0, len(x), ann.TILE):
            got.few @ x[a : a + ann.TILE].T
        plain.append(time.process_time() - at)
    assert min(took) < 25 * min(plain)
