"""Perception: worked molecules, patterns against a backtracking matcher, handedness, canonical strings of renumbered molecules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import canonical, patterns, perception
from pairloom.sources import molblocks, smiles

from .test_smiles import block

# String: aromatic atoms, donors, acceptors, spiro atoms, hydrogens by heavy atom, hybridisation of heavy atoms.
WORKED = {
    "c1ccccc1": ("012345", "", "", "", [1] * 6, "2 2 2 2 2 2"),
    "C1=CC=CC=C1": ("012345", "", "", "", [1] * 6, "2 2 2 2 2 2"),
    "c1cc[nH]c1": ("01234", "3", "", "", [1, 1, 1, 1, 1], "2 2 2 2 2"),
    "o1cccc1": ("01234", "", "0", "", [0, 1, 1, 1, 1], "2 2 2 2 2"),
    "s1cccc1": ("01234", "", "", "", [0, 1, 1, 1, 1], "2 2 2 2 2"),
    "c1ccncc1": ("012345", "", "3", "", [1, 1, 1, 0, 1, 1], "2 2 2 2 2 2"),
    "[nH]1cncc1": ("01234", "02", "2", "", [1, 1, 0, 1, 1], "2 2 2 2 2"),
    "c1ccc2cccc2cc1": ("0123456789", "", "", "", [1, 1, 1, 0, 1, 1, 1, 0, 1, 1], " ".join("2" * 10)),
    "O=c1cc[nH]cc1": ("123456", "4", "0", "", [0, 0, 1, 1, 1, 1, 1], "2 2 2 2 2 2 2"),
    "O=C1C=CC(=O)C=C1": ("", "", "05", "", [0, 0, 1, 1, 0, 0, 1, 1], " ".join("2" * 8)),
    "C1=CC=CC=CC=C1": ("", "", "", "", [1] * 8, " ".join("2" * 8)),
    "[cH-]1cccc1": ("01234", "", "", "", [1] * 5, "2 2 2 2 2"),
    "C1CC12CC2": ("", "", "", "2", [2, 2, 0, 2, 2], "3 3 3 3 3"),
    "CC#N": ("", "", "2", "", [3, 0, 0], "3 1 1"),
    "CC(=O)O": ("", "3", "23", "", [3, 0, 0, 1], "3 2 2 2"),
    "CC(=O)NC": ("", "3", "2", "", [3, 0, 0, 1, 3], "3 2 2 2 3"),
    "CN(C)C": ("", "1", "", "", [3, 0, 3, 3], "3 3 3 3"),
    "C[NH3+]": ("", "1", "", "", [3, 3], "3 3"),
    "CN(=O)=O": ("", "", "", "", [3, 0, 0, 0], "3 2 2 2"),
    "FC(F)(F)C": ("", "", "", "", [0, 0, 0, 0, 3], "3 3 3 3 3"),
    "CF": ("", "", "1", "", [3, 0], "3 3"),
    "CS": ("", "1", "", "", [3, 1], "3 3"),
    "FP(F)(F)(F)F": ("", "", "", "", [0] * 6, "3 3D 3 3 3 3"),
    "FS(F)(F)(F)(F)F": ("", "", "", "", [0] * 7, "3 3D2 3 3 3 3 3"),
}


@pytest.fixture(scope="module")
def worked(spark):
    d = smiles.rows(spark.createDataFrame(list(enumerate(WORKED)), "mol_key int, smiles string"))
    return {list(WORKED)[r.mol_key]: r for r in perception.perceived(d).collect()}


@pytest.mark.parametrize("text", WORKED)
def test_worked_molecules(worked, text):
    r = worked[text]
    heavy = [i for i, a in enumerate(r.atoms) if a.number > 1]
    assert r.error is None
    places = lambda flags: "".join(str(i) for i in heavy if flags[i])
    short = {"S": "S", "SP": "1", "SP2": "2", "SP3": "3", "SP3D": "3D", "SP3D2": "3D2"}
    got = (places([f.aromatic for f in r.facts]), places(r.donor), places(r.acceptor), places(r.spiro), [r.hydrogens[i] for i in heavy], " ".join(short[r.hybridization[i]] for i in heavy))
    assert got == WORKED[text]
    assert all(r.hybridization[i] == "S" and r.degree[i] == 1 for i in range(len(r.atoms)) if i not in heavy)
    assert all(r.implicit[i] == 0 for i in range(len(r.atoms)))


def test_valences_radicals_and_errors(spark):
    texts = ["C(C)(C)(C)(C)C", "[CH3]", "[O]", "C[N+](C)(C)C", "OCl(=O)(=O)=O", "O[Cl+3]([O-])([O-])[O-]", "N(C)(C)(C)C", "[Fe+2]", "CS(C)(=O)=O", "O=P(O)(O)O", "x"]
    d = perception.with_valence(smiles.rows(spark.createDataFrame(list(enumerate(texts)), "mol_key int, smiles string")))
    got = {texts[r.mol_key]: r for r in d.collect()}
    assert {t for t, r in got.items() if r.error} == {"C(C)(C)(C)(C)C", "OCl(=O)(=O)=O", "N(C)(C)(C)C", "x"}
    assert got["N(C)(C)(C)C"].error == "too many bonds at atom 0 (N)"
    assert got["[CH3]"].radicals == [1] and got["[O]"].radicals == [2] and got["[Fe+2]"].radicals == [0]
    assert got["O=P(O)(O)O"].implicit == [0, 0, 1, 1, 1]
    # Without hydrogens as atoms, what is stated and what is implicit count as hydrogens all the same.
    t = perception.atom_table(perception.perceived(smiles.rows(spark.createDataFrame([(1, "C[NH3+]"), (2, "x")], "mol_key int, smiles string")), hydrogens=False)).collect()
    assert [(a.symbol, a.explicitvalence, a.implicitvalence, a.totalnumHs, a.degree) for a in sorted(t, key=lambda a: a.idx)] == [("C", 1, 3, 3, 4), ("N", 4, 0, 3, 4)]


def test_tables(spark):
    d = perception.perceived(smiles.rows(spark.createDataFrame([("a", "CC=O"), ("b", "bad(")], "mol_key string, smiles string")))
    atoms, bonds = perception.atom_table(d), perception.bond_table(d)
    assert [(r.idx, r.symbol) for r in atoms.orderBy("idx").collect()] == list(enumerate("CCOHHHH"))
    assert [(r.begin, r.end, r.bond_type, r.length) for r in bonds.orderBy("begin", "end").collect()][:2] == [(0, 1, "SINGLE", None), (0, 3, "SINGLE", None)]
    assert perception.ring_table(d).collect() == [] and {r.mol_key for r in d.where("error IS NOT NULL").collect()} == {"b"}
    assert perception.perceived(smiles.rows(spark.createDataFrame([], "mol_key int, smiles string"))).collect() == []


def fits(p, atoms, at, came=None):
    """A backtracking matcher of patterns, by their definition."""
    a = atoms[at]
    plain = (not p.symbols or a["symbol"] in p.symbols) and p.aromatic in (None, a["aromatic"]) and (p.hydrogens is None or p.hydrogens[0] <= a["hydrogens"] <= p.hydrogens[1])
    plain = plain and all(v in (None, a[k]) for k, v in (("valence", p.valence), ("charge", p.charge), ("degree", p.degree))) and (p.not_degree is None or a["degree"] != p.not_degree)
    kinds = {"any": lambda n: True, "default": lambda n: n["aromatic"] or n["order"] == 1, "single": lambda n: not n["aromatic"] and n["order"] == 1, "double": lambda n: not n["aromatic"] and n["order"] == 2, "triple": lambda n: not n["aromatic"] and n["order"] == 3, "aromatic": lambda n: n["aromatic"]}
    if not plain:
        return False
    for x in p.near:
        found = [n["other"] for n in a["near"] if n["other"] != came and kinds[x.bond](n) and fits(x.atom, atoms, n["other"], at)]
        if (len(found) >= x.count) == x.absent:
            return False
    return True


def test_patterns_against_a_matcher(spark):
    rng, rows = random.Random(5), []
    for key in range(300):
        n = rng.randrange(1, 9)
        near = [[] for _ in range(n)]
        for a, b in {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(12))} if n > 1 else ():
            bond = {"order": rng.choice((1, 1, 2, 3)), "aromatic": rng.random() < 0.4}
            near[a].append({"other": b, **bond}), near[b].append({"other": a, **bond})
        rows.append((key, [{"symbol": rng.choice("NNNCCOOFS"), "charge": rng.choice((0, 0, 1, -1)), "degree": rng.randrange(1, 4), "hydrogens": rng.randrange(3), "valence": rng.randrange(1, 5), "aromatic": rng.random() < 0.5, "near": near[i]} for i in range(n)]))
    schema = "key int, facts array<struct<symbol:string,charge:int,degree:int,hydrogens:int,valence:int,aromatic:boolean,near:array<struct<other:int,order:int,aromatic:boolean>>>>"
    whole = {"donor": patterns.DONORS, "acceptor": patterns.ACCEPTORS}
    d = spark.createDataFrame(rows, schema).select("key", *[patterns.matches_any(p).alias(n) for n, p in whole.items()], *[patterns.matches_any([p]).alias(f"{n}{i}") for n, ps in whole.items() for i, p in enumerate(ps)])
    hits = 0
    for r in d.collect():
        atoms = rows[r.key][1]
        for name, ps in whole.items():
            assert r[name] == [any(fits(p, atoms, i) for p in ps) for i in range(len(atoms))]
            for k, p in enumerate(ps):
                assert r[f"{name}{k}"] == [fits(p, atoms, i) for i in range(len(atoms))]
                hits += sum(r[f"{name}{k}"])
    assert hits > 300


TAGGED = {"N[C@@H](C)C(=O)O": "S", "N[C@H](C)C(=O)O": "R", "C[C@H](O)CC": "S", "C[C@@H](F)Cl": "S", "C[C@H](C)O": "", "F[C@](Cl)(Br)I": "S", "[C@H](F)(Cl)Br": "S", "OC1CC[C@H](C)CC1": "", "C[C@@H]1CCCO1": "R"}


def test_tags(spark):
    d = perception.perceived(smiles.rows(spark.createDataFrame(list(enumerate(TAGGED)), "mol_key int, smiles string")))
    got = {list(TAGGED)[r.mol_key]: "".join(r.chirality) for r in d.collect()}
    assert got == TAGGED
    bare = perception.perceived(smiles.rows(spark.createDataFrame(list(enumerate(TAGGED)), "mol_key int, smiles string")), hydrogens=False)
    assert {list(TAGGED)[r.mol_key]: "".join(r.chirality) for r in bare.collect()} == TAGGED


def test_coordinates_and_their_mirror(spark):
    corners = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]
    made = {}
    for name, others in (("four", ["F", "Cl", "Br", "I"]), ("same", ["F", "F", "Br", "I"]), ("h", ["F", "Cl", "Br", "H"])):
        for side, f in (("left", 1), ("right", -1)):
            atoms = [("C", 0, 0, 0)] + [(s, x * f, y, z) for s, (x, y, z) in zip(others, corners, strict=True)]
            made[f"{name} {side}"] = block(name, atoms, [(0, i, 1) for i in range(1, 5)])
    atoms = [("C", 0, 0, 0)] + [(s, x, y, z) for s, (x, y, z) in zip(["F", "Cl", "Br"], corners, strict=False)]
    made["implicit left"] = block("implicit", atoms, [(0, i, 1) for i in range(1, 4)])
    made["implicit flat"] = block("flat", [("C", 0, 0, 0), ("F", 1, 0, 0), ("Cl", -1, 1, 0), ("Br", -1, -1, 0)], [(0, i, 1) for i in range(1, 4)])
    rows = molblocks.rows(spark.createDataFrame(list(made.items()), "mol_key string, block string"))
    got = {r.mol_key: "".join(r.chirality) for r in perception.perceived(rows, hydrogens=False).collect()}
    assert {got["four left"], got["four right"]} == {"R", "S"} and {got["h left"], got["h right"]} == {"R", "S"}
    assert got["same left"] == got["same right"] == got["implicit flat"] == ""
    assert got["implicit left"] == got["h left"]
    # The same molecule from its string.
    text = {r.mol_key: r.canonical for r in canonical.canonical(rows).collect()}
    assert text["h left"] != text["h right"] and "@" in text["four left"] and "@" not in text["same left"]
    back = perception.perceived(smiles.rows(spark.createDataFrame([(k, text[k]) for k in ("four left", "four right", "implicit left")], "mol_key string, smiles string")), hydrogens=False)
    assert {r.mol_key: "".join(r.chirality) for r in back.collect()} == {k: got[k] for k in ("four left", "four right", "implicit left")}


def rewritten(text, rng):
    """The same molecule with its atoms in another order."""
    atoms, bonds = smiles.read(text)
    near = [[] for _ in atoms]
    for a, b, o in bonds:
        near[a].append((b, o)), near[b].append((a, o))
    symbols = {1: "", 2: "=", 3: "#", 4: ":"}
    places = rng.sample(range(len(atoms)), len(atoms))
    order = sorted(range(len(atoms)), key=places.__getitem__)
    numbers = {frozenset(b[:2]): i + 1 for i, b in enumerate(bonds)}
    out = []
    for a in order:  # every bond as a ring closure between dots
        x = atoms[a]
        joined = rng.sample(near[a], len(near[a]))
        tag = ""
        if x["tag"]:
            shown = [-1] * x["hs"] + [b for b, _ in joined]
            tag = x["tag"] if not canonical._odd(shown, x["around"]) else {"@": "@@", "@@": "@"}[x["tag"]]
        symbol = x["symbol"].lower() if x["shared"] else x["symbol"]
        bracket = x["hs"] >= 0
        charge = f"{x['charge']:+d}" if x["charge"] else ""
        h = f"H{x['hs']}" if x["hs"] > 0 else ""
        text = f"[{x['isotope'] or ''}{symbol}{tag}{h}{charge}]" if bracket else symbol
        out.append(text + "".join(symbols[o] + f"%{numbers[frozenset((a, b))]:02d}" for b, o in joined))
    return ".".join(out)


MANY = [
    "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "c1ccc2cccc2cc1", "N[C@@H](C)C(=O)O", "C[C@H](O)[C@@H](F)Cl", "[Na+].[Cl-]", "C12C3C4C1C5C2C3C45", "CC(C)(C)c1cc(C(C)(C)C)cc(C(C)(C)C)c1", "CCO.CCO.CCO.OCC",
    "C(c1ccccc1)(c1ccccc1)(c1ccccc1)c1ccccc1", "OC[C@H]1OC(O)[C@H](O)[C@@H](O)[C@@H]1O", "O=C1C=CC(=O)C=C1", "[13CH3]C([2H])[2H]", "c1ccc2c(c1)ccc1ccccc12", "C1CCCCC1", "FS(F)(F)(F)(F)F", "CC(=O)Nc1ccc(O)cc1",
]


def test_canonical_strings_of_renumbered_molecules(spark):
    rng, rows = random.Random(6), []
    for i, text in enumerate(MANY):
        rows += [(i, text)] + [(i, rewritten(text, rng)) for _ in range(100)]
    got = canonical.canonical(smiles.rows(spark.createDataFrame(rows, "mol_key int, smiles string").repartition(4)))
    by = {r.mol_key: set(r.found) for r in got.groupBy("mol_key").agg(F.collect_set(F.coalesce("canonical", "error")).alias("found")).collect()}
    assert all(len(found) == 1 for found in by.values()), {MANY[k]: v for k, v in by.items() if len(v) > 1}
    texts = {k: found.pop() for k, found in by.items()}
    assert len(set(texts.values())) == len(MANY)
    again = canonical.canonical(smiles.rows(spark.createDataFrame(list(texts.items()), "mol_key int, smiles string"))).collect()
    assert {r.mol_key: r.canonical for r in again} == texts


def test_canonical_of_different_molecules(spark):
    texts = ["CCO", "OCC", "COC", "c1ccccc1", "C1=CC=CC=C1", "C1CCCCC1", "N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O", "NC(C)C(=O)O", "bad("]
    got = {r.mol_key: r for r in canonical.canonical(smiles.rows(spark.createDataFrame(list(enumerate(texts)), "mol_key int, smiles string"))).collect()}
    same = [got[i].canonical for i in range(len(texts))]
    assert same[0] == same[1] != same[2] and same[3] == same[4] != same[5] and len(set(same[6:9])) == 3
    assert same[9] is None and got[9].error


def test_refinement_ends_when_no_colour_is_shared(monkeypatch):
    """a round that could split nothing is not made."""
    from pairloom.operators import canonical

    rounds = []
    real = canonical._places
    monkeypatch.setattr(canonical, "_places", lambda keys: rounds.append(len(keys)) or real(keys))
    near = [[(1, 1)], [(0, 1), (2, 1)], [(1, 1)]]
    assert canonical.refined([0, 1, 1], near) == [0, 1, 2] and len(rounds) == 1
    assert canonical.refined([0, 1, 0], near) == [0, 1, 0] and len(rounds) == 2
