"""Fill-in-middle: rank and select, the transformation and its inverse against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import fill_in_middle as fim

LETTERS = "ab é日𝄞\n\0<>PSM"


def drawn(key):
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def by_hand(key, text, plan=fim.Plan()):
    t, (h1, h2, h3, h4) = text or "", drawn(key)
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, s, m = plan.sentinels
    if not t or any(x in t for x in plan.sentinels) or h3 % 100 >= plan.changed:
        return "plain", n, None, None, t
    if h4 % 100 < plan.suffix_first:
        return "spm", n, a, b - a, s + t[b:] + p + t[:a] + m + t[a:b]
    return "psm", n, a, b - a, p + t[:a] + s + t[b:] + m + t[a:b]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.choice((0, 1, 2, 9, 70, 700)))) for _ in range(n)]


@pytest.mark.parametrize("text", ["", "a", "é", "日本語", "ab" * 700, "𝄞" * 300, "é" * 256, *texts(20)])
def test_rank_and_select(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    bits = fim.Boundaries(data)
    starts = [i for i, x in enumerate(data) if x & 0xC0 != 0x80]
    assert bits.total == len(text) == len(starts)
    places = np.arange(len(data) + 1)
    assert bits.rank(places).tolist() == [sum(s < p for s in starts) for p in places]
    assert bits.select(np.arange(len(starts) + 1)).tolist() == [*starts, len(data)]


def test_slices_cover_all_rows(monkeypatch):
    monkeypatch.setattr(fim, "SLICE_BYTES", 10)
    assert list(fim._slices(np.array([3, 3, 3, 20, 0, 0, 11, 10]))) == [(0, 3), (3, 4), (4, 6), (6, 7), (7, 8)]
    assert list(fim._slices(np.array([], dtype=np.int64))) == []


def test_rearranged_of_a_slice():
    given = texts(300, 2)
    column = pa.array([x.encode() for x in given], pa.large_binary()).slice(7)
    draws = np.array([drawn(i) for i in range(7, 300)])
    got = zip(*[x.to_pylist() for x in fim.rearranged(column, draws, fim.Plan())], strict=True)
    assert list(got) == [by_hand(i, given[i]) for i in range(7, 300)]


def test_transform(spark):
    given = [None, "", "x", "a <P> b", "<S>", "<M", "<", "é" * 5000, "long " * 60_000, *texts(200, 3), "same", "same"]
    rows = [(i if i != 4 else None, t, "old", i) for i, t in enumerate(given)] + [(2, "x", "old", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, row int")
    d = fim.transform(docs)
    assert d.columns == ["doc_id", "text", "row", "form", "n", "prefix_chars", "middle_chars", "output"]
    got = d.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.form, r.n, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_plans(spark):
    plan = fim.Plan(("[pre]", "[suf]", "[mid]"), 100, 50)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(100, 4))], "doc_id long, text string")
    for r in fim.transform(docs, plan=plan).withColumn("back", fim.restored(F.col("output"), F.col("form"), plan)).collect():
        assert (r.form, r.n, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text, plan)
        assert r.back == r.text
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "z"), ("<P><S>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Plan(bad)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transform(empty).collect() == []
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert fim.op11_fill_in_middle(spark, str(tmp_path)).collect() == []
