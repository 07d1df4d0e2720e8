"""Pair graphs: two molecules as one graph, the second one's atoms numbered behind the first one's.

pairs has graph_id, key1 and key2. Everything is keyed by graph_id, and joins go over mol_key and graph_id, so
one graph's rows meet in one partition and no join is wider than a graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .molecules import both_ways, sites


def reversed_pairs(pairs: DataFrame) -> DataFrame:
    """The same pairs with the molecules swapped."""
    others = [c for c in pairs.columns if c not in ("key1", "key2")]
    return pairs.select(F.col("key2").alias("key1"), F.col("key1").alias("key2"), *others)


def sizes(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("mol_key").agg(F.count(F.lit(1)).cast("int").alias("n"))


def pair_graphs(pairs: DataFrame, atoms: DataFrame, names: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """pairs with n1, n2, n and name (`a&b`), for the pairs whose molecules are both known.

    strict: an unknown molecule is an error when the rows are read.
    """
    n = sizes(atoms)
    if names is not None:
        n = n.join(names.select("mol_key", "name"), "mol_key", "left")
    n = n.withColumn("name", F.coalesce(F.col("name") if names is not None else F.lit(None), F.col("mol_key").cast("string")))
    side = lambda i: n.select(F.col("mol_key").alias(f"key{i}"), F.col("n").alias(f"n{i}"), F.col("name").alias(f"name{i}"))
    how = "left" if strict else "inner"
    d = pairs.join(side(1), "key1", how).join(side(2), "key2", how)
    if strict:
        unknown = F.when(F.col("n1").isNull(), F.col("key1")).when(F.col("n2").isNull(), F.col("key2"))
        fail = F.raise_error(F.concat(F.lit("no molecule "), unknown.cast("string"))).cast("int")
        d = d.withColumn("n1", F.when(unknown.isNull(), F.col("n1")).otherwise(fail))
    return d.withColumn("n", F.col("n1") + F.col("n2")).withColumn("name", F.concat_ws("&", "name1", "name2")).drop("name1", "name2")


def _sides(graphs: DataFrame) -> DataFrame:
    """Two rows a graph: graph_id, mol_key, side and the offset of the side's atoms."""
    return graphs.select(
        "graph_id",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("side"), F.col("key1").alias("mol_key"), F.lit(0).alias("offset")),
                F.struct(F.lit(2).alias("side"), F.col("key2").alias("mol_key"), F.col("n1").alias("offset")),
            )
        ).alias("s"),
    ).select("graph_id", "s.side", "s.mol_key", "s.offset")


def pair_nodes(graphs: DataFrame, atoms: DataFrame) -> DataFrame:
    """graph_id, node_id, side and the atoms' columns. One join for both sides."""
    a = _sides(graphs).join(atoms, "mol_key")
    return a.withColumn("node_id", (F.col("idx") + F.col("offset")).cast("int")).drop("offset", "mol_key", "idx")


def pair_bonds(graphs: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, begin, end (as node ids) and the bonds' columns, one row a bond."""
    b = _sides(graphs).join(bonds, "mol_key")
    moved = {c: (F.col(c) + F.col("offset")).cast("int") for c in ("begin", "end")}
    return b.withColumns(moved).drop("offset", "mol_key", "side")


def pair_edges(graphs: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, src, dst and the bonds' columns, each bond from both ends."""
    b = pair_bonds(graphs, bonds).withColumn("mol_key", F.lit(0))
    return both_ways(b).drop("mol_key").withColumnsRenamed({"begin": "src", "end": "dst"})


#: Interactions, in the order of their channels: kinds of the sites that meet, and whether each molecule has either role.
INTERACTIONS = {"hbond": ("donor_hydrogens", "acceptors", True), "pipi_stack": ("aromatic", "aromatic", False), "contact": ("carbon_hydrogens", "acceptors", True)}


def _with_sites(graphs: DataFrame, atoms: DataFrame, bonds: DataFrame | None, names: list[str]) -> DataFrame:
    """graph_id, n1 and the sites of both molecules (each kind with 1 and 2 behind its name), one row a graph.

    Graphs meet whole molecules, in as many tasks as these are in: no table of atoms is dealt by graph.
    """
    kinds = sorted({k for x in names for k in INTERACTIONS[x][:2]})
    m = sites(atoms, bonds, kinds)
    side = lambda i: m.select(F.col("mol_key").alias(f"key{i}"), *[F.col(k).alias(f"{k}{i}") for k in kinds])
    # By key2 first: that is how pair_graphs leaves its rows.
    return graphs.select("graph_id", "key1", "key2", "n1").join(side(2), "key2").join(side(1), "key1").drop("key1", "key2")


def _across(name: str) -> Column:
    """src, dst of every site of an interaction's first kind on one side with every one of its second kind on the other side."""
    first, second, both = INTERACTIONS[name]

    def one(a: int, b: int) -> Column:
        at = lambda side, x: (x + (F.lit(0) if side == 1 else F.col("n1"))).cast("int")
        return F.flatten(F.transform(f"{first}{a}", lambda i: F.transform(f"{second}{b}", lambda j: F.struct(at(a, i).alias("src"), at(b, j).alias("dst")))))

    return F.concat(one(1, 2), one(2, 1)) if both else one(1, 2)


def _possible(graphs: DataFrame, atoms: DataFrame, bonds: DataFrame | None, name: str) -> DataFrame:
    return _with_sites(graphs, atoms, bonds, [name]).select("graph_id", F.inline(_across(name)))


def possible_hbonds(graphs: DataFrame, atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, src, dst: hydrogens of donors with acceptors of the other molecule."""
    return _possible(graphs, atoms, bonds, "hbond")


def possible_contacts(graphs: DataFrame, atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, src, dst: hydrogens of carbons with acceptors of the other molecule."""
    return _possible(graphs, atoms, bonds, "contact")


def possible_pipi_stacks(graphs: DataFrame, atoms: DataFrame) -> DataFrame:
    """graph_id, src, dst: aromatic atoms of the first molecule with those of the second."""
    return _possible(graphs, atoms, None, "pipi_stack")


def interaction_channels(
    graphs: DataFrame, atoms: DataFrame, bonds: DataFrame, first_channel: int, hbond: bool = True, pipi_stack: bool = False, contact: bool = False
) -> DataFrame | None:
    """graph_id, src, dst, channel, value 1: symmetric, each once; None if all are off. Order: hbond, pipi_stack, contact."""
    names = [x for x, on in (("hbond", hbond), ("pipi_stack", pipi_stack), ("contact", contact)) if on]
    if not names:
        return None

    def layer(name: str, channel: int) -> Column:
        ends = lambda p: F.array(F.struct(p["src"].alias("src"), p["dst"].alias("dst")), F.struct(p["dst"].alias("src"), p["src"].alias("dst")))
        cell = lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), F.lit(channel).alias("channel"), F.lit(1.0).alias("value"))
        return F.transform(F.array_distinct(F.flatten(F.transform(_across(name), ends))), cell)

    # A graph is one row, so its duplicates go in place.
    layers = [layer(x, first_channel + i) for i, x in enumerate(names)]
    return _with_sites(graphs, atoms, bonds, names).select("graph_id", F.inline(F.concat(*layers)))
