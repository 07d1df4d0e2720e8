"""Clustering around centroids against loops over Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from pairloom.llm import centroid_clustering as cc


def by_hand(rows, k, rounds, dimensions, scale=256):
    ok = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    draw = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(ok, key=lambda r: (draw(r[0]), r[1]))[:k]]
    dist = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min((dist(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in ok]
        for j in range(len(c)):
            m = [v for (_, v), a in zip(ok, own, strict=True) if a == j]
            if m:
                c[j] = [sum(x) // len(m) for x in zip(*m, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in ok]
    by = [sum(d for _, a, d in last if a == j) for j in range(len(c))]
    fits = lambda x: x if x < 2**63 else None
    return sorted([(i, a, fits(d), fits(by[a]), fits(sum(by)), ",".join(map(str, c[a]))) for i, a, d in last], key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster string")


def made(n, dimensions, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss((i % 5) * 0.2, 0.1) * spread for _ in range(dimensions)]) for i in range(n)]


@pytest.mark.parametrize("spread", [1.0, 1e6, 1e13, 1e30])
def test_against_loops(spark, spread):
    rows = made(150, 6, 1, spread)
    got = sorted(map(tuple, cc.cluster(vectors(spark, rows).repartition(3), 7, 3, 6).collect()), key=repr)
    assert got == by_hand(rows, 7, 3, 6)


def test_mixed_magnitudes_nulls_and_repeats(spark):
    rows = made(60, 4, 2)
    rows += [(100, [1e30, -1e30, 0.5, 1.0]), (101, [1e300, 0.0, 0.0, 0.0]), (102, [4e4, -4e4, 1.0, 0.0]), (103, None), (104, [1.0, None, 0.0, 0.0]), (105, [math.nan, 0.0, 0.0, 0.0]),
             (106, [math.inf, 0.0, 0.0, 0.0]), (107, [0.0] * 3), (108, [0.0] * 5), (None, [0.1] * 4), (None, [0.2] * 4)]
    rows += rows[:20] + [(7, [0.3] * 4)] * 9
    got = sorted(map(tuple, cc.cluster(vectors(spark, rows).repartition(4), 9, 4, 4).collect()), key=repr)
    assert got == by_hand(rows, 9, 4, 4)


def test_ties_and_empty_centroids(spark):
    rows = [(i, [0.0, 0.0]) for i in range(5)] + [(9, [1.0, 1.0])] * 3 + [(10, [-1.0, -1.0])]
    got = sorted(map(tuple, cc.cluster(vectors(spark, rows), 8, 2, 2).collect()), key=repr)
    assert got == by_hand(rows, 8, 2, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = made(3, 2, 3)
    assert sorted(map(tuple, cc.cluster(vectors(spark, rows), 40, 2, 2).collect()), key=repr) == by_hand(rows, 40, 2, 2)
    assert cc.cluster(vectors(spark, []), 40, 2, 2).collect() == []
    assert cc.cluster(vectors(spark, [(1, None)]), 40, 2, 2).collect() == []


def test_types_at_their_bounds():
    rng = np.random.default_rng(4)
    for top in (2**20, 2**24, 2**26, 2**31, 2**40, 2**52):
        x = np.floor(rng.uniform(-top, top, (30, 8)))
        c = cc._integers(np.floor(rng.uniform(-top, top, (5, 8))))
        want = [[sum((int(a) - b) ** 2 for a, b in zip(r, w, strict=True)) for w in c] for r in x.tolist()]
        assert [[int(v) for v in r] for r in cc.distances(x, c)] == want


def test_blocks_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cc, "BLOCK", 4)
    class Source:
        def mapInArrow(self, run, schema):
            column = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
            parts = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), column(np.arange(2 * a, 2 * b).reshape(-1, 2) / 256)], ["vec_id", "embedding"]) for a, b in ((0, 3), (3, 10), (10, 11))]
            return [b.to_pylist()[0] for b in run(iter(parts))]

    blocks = cc.packed(Source(), 2, 256)
    assert [b["n"] for b in blocks] == [4, 4, 3] and sum((b["ids"] for b in blocks), []) == list(range(11))
    assert np.concatenate([cc.unpacked(b["m"], b["n"], 2) for b in blocks]).ravel().tolist() == list(range(22))
