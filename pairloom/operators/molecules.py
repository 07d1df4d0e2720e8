"""Facts about single molecules, from the tables atoms, bonds and rings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cycles


def both_ways(bonds: DataFrame) -> DataFrame:
    """Every bond once from each end: begin and end swapped for the second."""
    others = [c for c in bonds.columns if c not in ("begin", "end")]
    return bonds.unionByName(bonds.select(F.col("end").alias("begin"), F.col("begin").alias("end"), *others))


def _gathered_atoms(atoms: DataFrame, *columns: str) -> DataFrame:
    return atoms.groupBy("mol_key").agg(F.collect_list(F.struct("idx", *columns)).alias("a"))


def _gathered_bonds(bonds: DataFrame) -> DataFrame:
    return bonds.where("begin IS NOT NULL AND end IS NOT NULL").groupBy("mol_key").agg(F.collect_list(F.struct("begin", "end")).alias("b"))


def _places(which: Callable[[Column], Column]) -> Column:
    """idx of the gathered atoms that are so."""
    return F.transform(F.filter("a", which), lambda x: x["idx"])


def _hydrogens(of: Callable[[Column], Column]) -> Column:
    """The hydrogens at the other end of the gathered bonds, of each bond end that is so. Without bonds none."""
    end = lambda e, i, j: F.struct(e[i].alias("idx"), e[j].alias("other"))
    ends = F.flatten(F.transform("b", lambda e: F.array(end(e, "begin", "end"), end(e, "end", "begin"))))
    bonded = F.filter(ends, lambda e: of(e["idx"]) & F.array_contains(_places(lambda x: x["symbol"] == "H"), e["other"]))
    return F.coalesce(F.transform(bonded, lambda e: e["other"]), F.array().cast("array<int>"))


def with_neighbours(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """A row for each atom and bonded neighbour: mol_key, idx, symbol, is_donor, other, other_symbol.

    A molecule's atoms and bonds are gathered to one row each, and unfolded where the two meet: what is dealt and sorted are molecules.
    """
    a = _gathered_atoms(atoms, "symbol", "is_donor")
    d = _gathered_bonds(bonds).join(a, "mol_key").select("mol_key", "a", F.inline("b"))
    ends = F.array(F.struct(F.col("begin").alias("idx"), F.col("end").alias("other")), F.struct(F.col("end").alias("idx"), F.col("begin").alias("other")))
    d = d.select("mol_key", "a", F.inline(ends))
    of = lambda end: F.filter("a", lambda x: x["idx"] == F.col(end))
    d = d.select("mol_key", "idx", "other", of("other").alias("o"), F.explode(of("idx")).alias("x"))
    return d.select("mol_key", "idx", "x.symbol", "x.is_donor", "other", F.explode("o.symbol").alias("other_symbol"))


def adjacent_hydrogens(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """mol_key, idx, h: the hydrogens bonded to each atom."""
    return with_neighbours(atoms, bonds).where("other_symbol = 'H'").select("mol_key", "idx", F.col("other").alias("h"))


def donors(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """mol_key, idx and hs: each donor with the list of its hydrogens (may be empty). A molecule is one row until its donors are unfolded."""
    d = _gathered_atoms(atoms, "symbol", "is_donor").join(_gathered_bonds(bonds), "mol_key", "left")
    d = d.select("mol_key", "a", "b", F.explode(_places(lambda x: x["is_donor"])).alias("idx"))
    return d.select("mol_key", "idx", F.sort_array(_hydrogens(lambda i: i == F.col("idx"))).alias("hs"))


def donor_hydrogens(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """mol_key, idx: hydrogens of donors."""
    return with_neighbours(atoms, bonds).where("is_donor AND other_symbol = 'H'").select("mol_key", F.col("other").alias("idx"))


def carbon_hydrogens(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """mol_key, idx: hydrogens of carbon atoms."""
    return with_neighbours(atoms, bonds).where("symbol = 'C' AND other_symbol = 'H'").select("mol_key", F.col("other").alias("idx"))


def acceptors(atoms: DataFrame) -> DataFrame:
    return atoms.where("is_acceptor").select("mol_key", "idx")


def aromatic_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.where("is_aromatic").select("mol_key", "idx")


#: Kinds of sites where molecules meet, and the columns of atoms that they ask for. Hydrogens ask for bonds, too.
SITES = {"donor_hydrogens": ["symbol", "is_donor"], "carbon_hydrogens": ["symbol"], "acceptors": ["is_acceptor"], "aromatic": ["is_aromatic"]}


def sites(atoms: DataFrame, bonds: DataFrame | None, kinds: Iterable[str]) -> DataFrame:
    """mol_key and an array of idx for each of the kinds, one row a molecule.

    All are read off the molecule's gathered atoms and bonds at once, so what is joined and dealt further on are molecules.
    """
    kinds = list(kinds)
    d = _gathered_atoms(atoms, *sorted({c for k in kinds for c in SITES[k]}))
    if any(k.endswith("hydrogens") for k in kinds):
        d = d.join(_gathered_bonds(bonds), "mol_key", "left")
    found = {
        "donor_hydrogens": lambda: _hydrogens(lambda i: F.array_contains(_places(lambda x: x["is_donor"]), i)),
        "carbon_hydrogens": lambda: _hydrogens(lambda i: F.array_contains(_places(lambda x: x["symbol"] == "C"), i)),
        "acceptors": lambda: _places(lambda x: x["is_acceptor"]),
        "aromatic": lambda: _places(lambda x: x["is_aromatic"]),
    }
    return d.select("mol_key", *[found[k]().alias(k) for k in kinds])


def spiro_atoms(rings: DataFrame) -> DataFrame:
    """mol_key, idx: atoms that two rings (mol_key, ring_id, atom_ids) share, and share nothing else.

    Rings meet through the atoms they share, not all with all.
    """
    at = rings.select("mol_key", "ring_id", F.explode(F.array_distinct("atom_ids")).alias("idx"))
    other = at.select("mol_key", F.col("ring_id").alias("other"), "idx")
    shared = at.join(other, ["mol_key", "idx"]).where("ring_id < other")
    single = shared.groupBy("mol_key", "ring_id", "other").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx")).where("n = 1")
    return single.select("mol_key", "idx").distinct()


# Atom types that the default change of the hydrogen-bond criterion makes donors.
DONOR_CHANGES = {"sp C": True, "sp2 C": True, "sp3 C": True, "aromatic C": True, "carboncationic C": True}


def change_hbond_criterion(atoms: DataFrame, donor_types: dict[str, bool] | None = None, acceptor_types: dict[str, bool] | None = None) -> DataFrame:
    """atoms (with atom_type), is_donor and is_acceptor set anew for the types that are named."""

    def override(flag: str, changes: dict[str, bool]) -> Column:
        chain = F
        for name, value in changes.items():
            chain = chain.when(F.col("atom_type") == name, F.lit(value))
        return F.col(flag) if chain is F else chain.otherwise(F.col(flag))

    return atoms.withColumns(
        {"is_donor": override("is_donor", DONOR_CHANGES if donor_types is None else donor_types), "is_acceptor": override("is_acceptor", acceptor_types or {})}
    )


def same_coordinates(left: DataFrame, right: DataFrame) -> DataFrame:
    """mol_key and valid: whether two readings of a molecule have the same atoms at exactly the same places."""
    r = right.select("mol_key", "idx", *[F.col(c).alias(f"r{c}") for c in "xyz"], F.lit(True).alias("there"))
    l = left.select("mol_key", "idx", "x", "y", "z", F.lit(True).alias("here"))  # noqa: E741
    same = F.col("here").isNotNull() & F.col("there").isNotNull()
    for c in "xyz":
        same &= F.col(c).eqNullSafe(F.col(f"r{c}"))
    return l.join(r, ["mol_key", "idx"], "full").groupBy("mol_key").agg(F.bool_and(same).alias("valid"))


def rings(bonds: DataFrame) -> DataFrame:
    """mol_key, ring_id and atom_ids (in order): the smallest rings of each molecule, from its bonds alone (see functions.cycles).

    A molecule is one row meanwhile. Repeated bonds count once; bonds from an atom to itself and those with a null end not at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ends in batch.column(1).to_pylist():
                names = sorted({x for e in ends for x in e.values()})
                place = {x: i for i, x in enumerate(names)}
                found.append([[names[i] for i in r] for r in cycles.rings(len(names), [(place[e["a"]], place[e["b"]]) for e in ends])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.int64())))], ["mol_key", "rings"])

    end = lambda f: f(F.col("begin").cast("long"), F.col("end").cast("long"))
    pairs = bonds.where("begin != end").select("mol_key", F.struct(end(F.least).alias("a"), end(F.greatest).alias("b")).alias("e"))
    whole = pairs.groupBy("mol_key").agg(F.array_sort(F.collect_set("e")).alias("e"))
    kind = bonds.schema["mol_key"].dataType.simpleString()
    return whole.mapInArrow(run, f"mol_key {kind}, rings array<array<long>>").select("mol_key", F.posexplode("rings").alias("ring_id", "atom_ids"))


def ring_bonds(rings: DataFrame) -> DataFrame:
    """mol_key, begin, end (begin < end) and size (of the smallest ring) of the bonds that are in rings."""
    pairs = F.transform("atom_ids", lambda a, i: F.struct(a.alias("a"), F.get("atom_ids", F.pmod(i + 1, F.size("atom_ids"))).alias("b")))
    d = rings.select("mol_key", F.size("atom_ids").alias("size"), F.explode(pairs).alias("p"))
    return d.groupBy("mol_key", F.least("p.a", "p.b").alias("begin"), F.greatest("p.a", "p.b").alias("end")).agg(F.min("size").alias("size"))
