"""SMILES: each construct, malformed strings, rows; molecule blocks and records as rows."""

from __future__ import annotations

import pytest

from pairloom.sources import molblocks, smiles


def shape(text):
    atoms, bonds = smiles.read(text)
    return " ".join(a["symbol"] for a in atoms), [tuple(b) for b in bonds]


@pytest.mark.parametrize(
    ("text", "symbols", "bonds"),
    [
        ("C", "C", []),
        ("CCl", "C Cl", [(0, 1, 1)]),
        ("BrC=O", "Br C O", [(0, 1, 1), (1, 2, 2)]),
        ("C#N", "C N", [(0, 1, 3)]),
        ("CC(=O)(O)S", "C C O O S", [(0, 1, 1), (1, 2, 2), (1, 3, 1), (1, 4, 1)]),
        ("C(C(C))F", "C C C F", [(0, 1, 1), (1, 2, 1), (0, 3, 1)]),
        ("C1CC1", "C C C", [(0, 1, 1), (1, 2, 1), (0, 2, 1)]),
        ("C=1CC1", "C C C", [(0, 1, 1), (1, 2, 1), (0, 2, 2)]),
        ("C1CC=1", "C C C", [(0, 1, 1), (1, 2, 1), (0, 2, 2)]),
        ("C%12CC%12", "C C C", [(0, 1, 1), (1, 2, 1), (0, 2, 1)]),
        ("C12CC1C2", "C C C C", [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1), (0, 3, 1)]),
        ("C.O", "C O", []),
        ("c1ccccc1", "C C C C C C", [(0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 4, 4), (4, 5, 4), (0, 5, 4)]),
        ("F/C=C\\F", "F C C F", [(0, 1, 1), (1, 2, 2), (2, 3, 1)]),
        ("c1[se]cc1-c", "C Se C C C", [(0, 1, 4), (1, 2, 4), (2, 3, 4), (0, 3, 4), (3, 4, 1)]),
    ],
)
def test_constructs(text, symbols, bonds):
    assert shape(text) == (symbols, bonds)


@pytest.mark.parametrize(
    ("text", "charge", "isotope", "hs"),
    [("[NH4+]", 1, 0, 4), ("[O-]", -1, 0, 0), ("[13CH3]", 0, 13, 3), ("[Fe++]", 2, 0, 0), ("[Fe+3]", 3, 0, 0), ("[OH-:7]", -1, 0, 1), ("[C--]", -2, 0, 0), ("C", 0, 0, -1), ("[H]", 0, 0, 0), ("[2H]", 0, 2, 0)],
)
def test_brackets(text, charge, isotope, hs):
    (a,), _ = smiles.read(text)
    assert (a["charge"], a["isotope"], a["hs"]) == (charge, isotope, hs)


def test_tags_keep_the_order_of_neighbours():
    around = lambda text: [a["around"] for a in smiles.read(text)[0] if a["tag"]]
    assert around("N[C@@H](C)C(=O)O") == [[0, -1, 2, 3]]
    assert around("[C@H](N)(C)O") == [[-1, 1, 2, 3]]
    assert around("N[C@]1(F)CC1") == [[0, 4, 2, 3]]  # the ring's digit stands before the branch
    assert around("C1C[C@@]1(N)F") == [[1, 0, 3, 4]]


MALFORMED = ["", " ", "C(", "C)", "C1", "(C)", "C()", "=C", "C=", "C==C", "C1CC=1C-1", "C-1CC=1", "C..C", ".C", "C.", "[C", "C]", "[Xx]", "[*]", "x", "C1C1", "C11", "[C@@@H]", "1CC1", "C(=)C", "C$C", "c1cccc1", "cc", "n1cccc1", "(=C)"]


@pytest.mark.parametrize("text", MALFORMED)
def test_malformed(text):
    with pytest.raises(ValueError):
        smiles.finished(*smiles.read(text))


def test_rows_tell_errors(spark):
    texts = [None, *MALFORMED, "CCO", " CCO name ", "c1ccccc1", "C" * 20_000]
    got = {r.mol_key: r for r in smiles.rows(spark.createDataFrame(list(enumerate(texts)), "mol_key int, smiles string")).collect()}
    assert len(got) == len(texts)
    for i in range(len(MALFORMED) + 1):
        assert got[i].error and got[i].atoms is None, texts[i]
    fine = [got[i] for i in range(len(MALFORMED) + 1, len(texts))]
    assert [(r.error, len(r.atoms), len(r.bonds)) for r in fine] == [(None, 3, 2), (None, 3, 2), (None, 6, 6), (None, 20_000, 19_999)]
    assert [b.order for b in fine[2].bonds].count(2) == 3 and fine[2].rings == [[0, 1, 2, 3, 4, 5]]
    assert smiles.rows(spark.createDataFrame([], "mol_key int, smiles string")).collect() == []


def test_files_of_strings(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO ethanol\n\nc1ccccc1\tbenzene ring\nN\nbad( thing\n")
    got = {r.mol_key: r.error for r in smiles.read_smiles(spark, str(tmp_path / "a.smi")).collect()}
    assert set(got) == {"ethanol", "benzene ring", "N", "thing"} and [k for k, e in got.items() if e] == ["thing"]


def test_biphenyl_and_nitro():
    for text in ("c1ccccc1c1ccccc1", "c1ccccc1-c1ccccc1"):
        _, bonds, rings = smiles.finished(*smiles.read(text))
        assert next(b for b in bonds if (b["begin"], b["end"]) == (5, 6)) == {"begin": 5, "end": 6, "order": 1, "in_ring": False} and len(rings) == 2
    atoms, bonds, _ = smiles.finished(*smiles.read("CN(=O)=O"))
    assert [a["charge"] for a in atoms] == [0, 1, -1, 0] and [b["order"] for b in bonds] == [1, 1, 2]


def block(name, atoms, bonds, extra=""):
    lines = [name, "", "", f"{len(atoms):3d}{len(bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    lines += [f"{x:10.4f}{y:10.4f}{z:10.4f} {s:3s} 0  0" for s, x, y, z in atoms]
    lines += [f"{a + 1:3d}{b + 1:3d}{o:3d}  0" for a, b, o in bonds]
    return "\n".join([*lines, extra + "M  END"]) + "\n"


def hexagon(kind):
    atoms = [("C", float(i), float(i % 2), 0.0) for i in range(6)]
    return block("ring", atoms, [(i, (i + 1) % 6, kind) for i in range(6)])


def test_blocks_as_rows(spark):
    blocks = {"aromatic": hexagon(4), "other": hexagon(5), "salt": block("salt", [("Na", 0, 0, 0), ("Cl", 2, 0, 0)], [], "M  CHG  2   1   1   2  -1\n"), "bad": "x", "odd": block("o", [("Zz", 0, 0, 0)], [])}
    d = molblocks.rows(spark.createDataFrame(list(blocks.items()), "mol_key string, block string"))
    got = {r.mol_key: r for r in d.collect()}
    assert [b.order for b in got["aromatic"].bonds].count(2) == 3 and got["aromatic"].atoms[3].x == 3.0
    assert [a.charge for a in got["salt"].atoms] == [1, -1]
    assert [got[k].error for k in ("other", "bad", "odd")] == ["a bond of unknown order", "the block can't be read", "an unknown element"]


def test_records_are_split(spark, tmp_path):
    path = tmp_path / "many.sdf"
    records = [block(f"m{i}", [("C", i, 0, 0), ("O", i, 1, 0)], [(0, 1, 1)]) + f"> <id>\nx{i}\n\n" for i in range(300)]
    path.write_text("$$$$\n".join(records) + "$$$$\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # records cross the borders of splits
    try:
        d = molblocks.read_records(spark, str(path))
        assert d.rdd.getNumPartitions() > 5
        assert sorted(r.mol_key for r in d.collect()) == sorted(f"m{i}" for i in range(300))
        assert {r.mol_key: (r.error, len(r.atoms)) for r in molblocks.rows(d).collect()} == {f"m{i}": (None, 2) for i in range(300)}
        by_field = molblocks.read_records(spark, str(path), r"regexp_extract(block, '> <id>\n(.*)\n', 1)")
        assert {r.mol_key for r in by_field.collect()} == {f"x{i}" for i in range(300)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_few_molecules_are_python_objects_at_once(monkeypatch):
    import pyarrow as pa

    from pairloom.sources import rows

    monkeypatch.setattr(rows, "ROWS_AT_ONCE", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], ["k"])
    parts = list(rows.slices(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [4, 4, 2] and [k for p in parts for k in p.column(0).to_pylist()] == list(range(10))
