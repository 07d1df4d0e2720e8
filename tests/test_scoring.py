"""From structures to scores in one call: strings, registry numbers, blocks and records."""

from __future__ import annotations

import pytest

from pairloom.operators import network, scoring
from pairloom.sources import molblocks

from .test_smiles import block

CAFFEINE, ACID = "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "OC(=O)CC(=O)O"


@pytest.fixture(scope="module")
def params():
    return network.initial_params(seed=1)


def scored(spark, params, rows, **options):
    d = scoring.score_structures(spark.createDataFrame(rows, "graph_id int, input1 string, input2 string"), params, **options)
    return {r.graph_id: r for r in d.collect()}


def test_strings(spark, params):
    got = scored(spark, params, [(1, CAFFEINE, ACID), (2, ACID, CAFFEINE), (3, "c1ccc", ACID), (4, ACID, None), (5, "[Na+]", ACID), (6, ACID, ACID), (7, "Cn1cnc2c1c(=O)n(C)c(=O)n2C", ACID)], kind="smiles")
    assert (got[1].n1, got[1].n2, got[1].error) == (24, 11, None) and abs(sum(got[1].probs) - 1) < 1e-9
    assert got[1].probs == pytest.approx(got[2].probs, abs=1e-9)  # both orders are averaged
    assert got[1].probs == pytest.approx(got[7].probs, abs=1e-9)  # the same molecule, written with aromatic atoms
    assert got[3].error.startswith("first input: ") and got[4].error.startswith("second input: ") and got[3].probs is None and got[3].n2 == 11
    assert got[5].error == "atoms or bonds outside the vocabularies" and got[6].error is None
    assert got[1]["class"] in ("negative", "salt", "cocrystal", "solvate")


def test_registry_numbers(spark, params):
    tier = spark.createDataFrame([("58-08-2", CAFFEINE)], "cas string, value string")
    asked = lambda cas: {"141-82-2": ACID}.get(cas)
    rows = [(1, "58-08-2", "141-82-2"), (2, "58-08-2", "0-0-0")]
    got = scored(spark, params, rows, kind="cas", tiers=[tier], resolver=asked)
    by_string = scored(spark, params, [(1, CAFFEINE, ACID)])
    assert got[1].probs == pytest.approx(by_string[1].probs, abs=1e-9)
    assert got[2].error == "second input: no structure is known for 0-0-0"


def test_blocks_and_records(spark, params, tmp_path):
    ethanol = block("ethanol", [("C", 0, 0, 0), ("C", 1.5, 0, 0), ("O", 2, 1.3, 0)], [(0, 1, 1), (1, 2, 1)])
    water = block("water", [("O", 0, 0, 0), ("H", 1, 0, 0), ("H", -0.3, 0.9, 0)], [(0, 1, 1), (0, 2, 1)])
    (tmp_path / "m.sdf").write_text(f"{ethanol}$$$$\n{water}$$$$\n")
    got = scored(spark, params, [(1, ethanol, water), (2, "no block", water)], kind="mol_block", mode="WithDistanceMatrix")
    assert (got[1].n1, got[1].n2, got[1].error) == (3, 3, None) and got[2].error == "first input: the block can't be read"
    records = molblocks.read_records(spark, str(tmp_path / "m.sdf"))
    by_key = scored(spark, params, [(1, "ethanol", "water"), (2, "ethanol", "wine")], kind="sdf", blocks=records, mode="WithDistanceMatrix")
    assert by_key[1].probs == pytest.approx(got[1].probs, abs=1e-9) and by_key[2].error.startswith("second input: ")


def test_unknown_kind(spark, params):
    with pytest.raises(ValueError, match="unknown kind"):
        scored(spark, params, [(1, "C", "C")], kind="inchi")


def test_a_molecule_is_convolved_once_for_all_its_pairs(spark, params, monkeypatch):
    """Where edges are bonds, scores come from each molecule's sums; they are those of the pairs' graphs."""
    from pairloom.operators import assembly, perception
    from pairloom.sources import smiles

    texts = [CAFFEINE, ACID, "CCO", "C1CC1N", "[Na+]"]
    made = perception.perceived(smiles.rows(spark.createDataFrame(list(enumerate(texts)), "mol_key int, smiles string"))).localCheckpoint()
    atoms, bonds = perception.atom_table(made), perception.bond_table(made)
    pairs = spark.createDataFrame([(10 * a + b, a, b) for a in range(6) for b in range(6)] + [(99, None, 1)], "graph_id int, key1 int, key2 int")
    whole = pairs.selectExpr("*", "0 AS label", "'' AS tag", "'' AS last")
    for mode, pad_to in (("OnlyCovalentBond", 40), ("WithRingAndConjugated", None)):
        samples = assembly.samples(assembly.build_dataset(whole, atoms, bonds, mode, strict=False, denied=[]))
        fitting = samples if pad_to is None else samples.where(f"n <= {pad_to}")
        expected = {r.graph_id: r.probs for r in network.both_orders(fitting, params, pad_to).collect()}
        with monkeypatch.context() as m:
            m.setattr(network, "both_orders", lambda *a: pytest.fail("a pair's graph was convolved"))
            got = {r.graph_id: r for r in scoring.score_pairs(pairs, atoms, bonds, params, mode, pad_to).collect()}
        assert len(got) == 37 and {k for k, r in got.items() if r.error is None} == set(expected)
        assert all(got[k].probs == pytest.approx(v, abs=1e-9) for k, v in expected.items())
        assert got[44].error == "atoms or bonds outside the vocabularies" and got[5].error == "no molecule: 5" and got[99].error == "no molecule: null"
        assert got[0].error == (None if pad_to is None else "more nodes than the padded size") and got[0].probs == (None if pad_to else got[0].probs)


def test_molecules_of_few_pairs_are_not_stored_as_sums(spark, params, monkeypatch):
    """F8: where keys repeat little, pairs meet the molecules; scores and errors are those of the sums."""
    from pairloom.operators import perception
    from pairloom.sources import smiles

    made = perception.perceived(smiles.rows(spark.createDataFrame(list(enumerate([CAFFEINE, ACID, "CCO", "C1CC1N", "[Na+]"])), "mol_key int, smiles string"))).localCheckpoint()
    atoms, bonds = perception.atom_table(made), perception.bond_table(made)
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3), (2, 4, 9), (3, 5, None), (4, 3, 4)], "graph_id int, key1 int, key2 int")
    for pad_to in (None, 12):
        monkeypatch.setattr(scoring, "SEVERAL", 0)
        want = {r.graph_id: r for r in scoring.score_pairs(pairs, atoms, bonds, params, pad_to=pad_to).collect()}
        monkeypatch.setattr(scoring, "SEVERAL", 4)
        with monkeypatch.context() as m:
            m.setattr(network, "sums", lambda *a: pytest.fail("sums were stored"))
            got = {r.graph_id: r for r in scoring.score_pairs(pairs, atoms, bonds, params, pad_to=pad_to).collect()}
        assert got.keys() == want.keys() and len({r.error for r in want.values()}) > 2
        for k, r in want.items():
            assert (got[k].error, got[k]["class"], got[k].key1, got[k].key2) == (r.error, r["class"], r.key1, r.key2)
            assert (got[k].probs is None) == (r.probs is None) and (r.probs is None or got[k].probs == pytest.approx(r.probs, abs=1e-9))
