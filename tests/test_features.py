from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pairloom.functions import features as ft
from pairloom.sources import lookups, molblocks
from pairloom.sources import pairs as ps


def one(spark, column, kind="string", values=()):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(column).collect()]


def test_distance_bins(spark):
    values = [0.0, 1.999, 2.0, 2.5, 5.999, 6.0, 1e9, math.nan]
    assert one(spark, ft.distance_bin(F.col("v")), "double", values) == [0, 0, 1, 2, 8, 9, 9, 9]


def test_type_numbers(spark):
    assert one(spark, ft.type_number(F.col("v")), values=["SINGLE", "DOUBLE", "TRIPLE", "AROMATIC", "DATIVE", None]) == [1, 2, 3, 4, 5, 5]


def test_charge_strip(spark):
    text = "M  CHG  1   1   1\nabc      5\nabc     5\n"
    assert one(spark, ft.strip_charges(F.col("v")), values=[text, "", None]) == ["abc      0\nabc     5\n", "", None]


def test_softmax_and_argmax(spark):
    p = one(spark, ft.softmax(F.col("v")), "array<double>", [[0.0, 0.0], [1000.0, 0.0]])
    assert p[0] == [0.5, 0.5] and p[1][0] == 1.0
    assert one(spark, ft.argmax(F.col("v")), "array<double>", [[0.5, 0.5], [0.1, 0.9]]) == [0, 1]


def test_one_hot_width():
    assert ft.N_FEATURES == 34


def test_header_sniff(spark):
    assert one(spark, ps.looks_like_header(F.col("v")), values=["A1,B2,x,1,BOVQUY", "A1,B2,0,1,X9", "name", "a b,1"]) == [True, False, False, False]


def test_read_pairs(spark, tmp_path):
    (tmp_path / "h.csv").write_text("key1,key2,aux,label,tag\nA1,B2,0,1,X9\n\n A3,B4,0,2,BOVQUY \nA1,B2,0,bad,LADBIB01,q\n")
    d = ps.read_pairs(spark, str(tmp_path / "h.csv"))
    assert [tuple(r) for r in d.orderBy("tag").collect()] == [
        ("A3", "B4", 2, "BOVQUY", "BOVQUY"), ("A1", "B2", None, "LADBIB01", "q"), ("A1", "B2", 1, "X9", "X9"),
    ]
    assert ps.read_pairs(spark, str(tmp_path / "h.csv"), header=False).count() == 4
    # The last field decides, not the tag.
    assert {r.tag for r in ps.without_denied(d).collect()} == {"LADBIB01", "X9"}
    ok, bad = ps.checked_labels(d)
    assert ok.count() == 2 and bad.count() == 1


def test_header_is_sniffed_for_each_file(spark, tmp_path):
    folder = tmp_path / "some pairs"
    folder.mkdir()
    (folder / "a.csv").write_text("key1,key2,aux,label,tag\nA1,B2,0,1,X1\n")
    (folder / "b.csv").write_text("A3,B4,0,2,X2\nA5,B6,0,2,X3\n")
    (folder / "c.csv").write_text("")
    assert sorted(r.tag for r in ps.read_pairs(spark, str(folder)).collect()) == ["X1", "X2", "X3"]
    assert ps.read_pairs(spark, str(folder / "c.csv")).count() == 0


def test_lookup_with_resolver(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "cas string")
    tier = spark.createDataFrame([("a", "A")], "cas string, value string")

    def resolver(key):
        if key == "b":
            raise OSError
        return key * 2

    got = sorted((r.cas or "", r.value) for r in lookups.resolve(rows, "cas", [tier], resolver=resolver).collect())
    assert got == [("", None), ("a", "A"), ("b", None), ("c", "cc"), ("c", "cc")]
    assert lookups.resolve(rows, "cas", []).where("value IS NOT NULL").count() == 0


BLOCK = """water
  test

  3  2  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.0000 O   0  0
    0.9600    0.0000    0.0000 H   0  0
   -0.2400    0.9300    0.0000 H   0  0
  1  2  1  0
  1  3  2  0
M  CHG  2   1  -1   3   1
M  END"""


def test_molblock(spark):
    d = spark.createDataFrame([("w", BLOCK), ("broken", "x\n\n\n  9  9"), ("empty", ""), ("null", None)], "mol_key string, block string")
    assert {r.mol_key: r.valid for r in molblocks.molecules(d).collect()} == {"w": True, "broken": False, "empty": False, "null": False}
    a = {r.idx: (r.symbol, r.formalcharge, r.atomic_number) for r in molblocks.atoms(d).collect()}
    assert a == {0: ("O", -1, 8), 1: ("H", 0, 1), 2: ("H", 1, 1)}
    b = {(r.begin, r.end): (r.bond_type, r.type_number, round(r.length, 4)) for r in molblocks.bonds(d).collect()}
    assert b == {(0, 1): ("SINGLE", 1, 0.96), (0, 2): ("DOUBLE", 2, 0.9605)}


@pytest.mark.parametrize(("z", "metal"), [(1, False), (3, True), (11, True), (14, False), (26, True), (32, False), (118, True)])
def test_metals(spark, z, metal):
    assert one(spark, ft.is_metal(F.col("v")), "int", [z]) == [metal]


def test_a_block_is_split_once(spark):
    d = spark.createDataFrame([("w", "block")], "mol_key string, block string")
    for made in (molblocks.molecules(d), molblocks.atoms(d), molblocks.bonds(d)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("split(block") <= 1
