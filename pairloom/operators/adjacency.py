"""Edge channels of graphs in seven modes, as sparse rows graph_id, src, dst, channel, value.

Inputs are nodes (graph_id, node_id, x, y, z) and bonds (graph_id, begin, end, type_number, length, is_ring,
is_conjugated; one row a bond). Modes and channels:

covalent 0-3 | bond length 0-3, 4 length | distance 0-3, 4 distance | ring 0-3, 4 conjugated, 5 ring |
all 0-5, 6 distance | binned distance 0-3, 4-13 bins | all binned 0-5, 6-15 bins

A bond of another type (5) makes its graph invalid in the modes covalent, distance and binned distance. In the
others it has no type channel; without length, ring or conjugation it then is no edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import distance_bin, euclidean
from .pairs import interaction_channels

# Accepted spellings of the modes, in lower case, and their numbers of channels.
MODES = {
    "onlycovalentbond": "covalent", "withbondlenth": "length", "withbondlength": "length", "withdistancematrix": "distance",
    "isringandconjugated": "ring", "withringandconjugated": "ring", "allfeature": "all",
    "withbinbistancematrix": "bins", "withbindistancematrix": "bins", "allfeaturebin": "allbins",
}
CHANNELS = {"covalent": 4, "length": 5, "distance": 5, "ring": 6, "all": 7, "bins": 14, "allbins": 16}
STRICT = ("covalent", "distance", "bins")
#: Modes whose channels are those of bonds, so that none joins the two molecules of a pair.
BONDS_ONLY = ("covalent", "length", "ring")


def mode_of(name: str) -> str:
    mode = MODES.get(name.lower())
    if mode is None:
        raise ValueError(f"unknown adjacency mode {name!r}; one of {sorted(MODES)}")
    return mode


def invalid_graphs(bonds: DataFrame, name: str) -> DataFrame:
    """graph_id of graphs that the mode rejects."""
    bad = F.col("type_number") > 4 if mode_of(name) in STRICT else F.lit(False)
    return bonds.where(bad).select("graph_id").distinct()


def node_distances(nodes: DataFrame) -> DataFrame:
    """graph_id, src, dst, distance of all pairs of a graph's nodes, both ways, without the diagonal.

    One shuffle: a graph's places are gathered (a graph is small by definition) and its pairs unfolded in place.
    """
    spot = F.struct("node_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    g = nodes.groupBy("graph_id").agg(F.collect_list(spot).alias("v"))
    d = g.select("graph_id", "v", F.explode("v").alias("a")).select("graph_id", "a", F.explode("v").alias("b")).where("a.node_id <> b.node_id")
    length = euclidean([F.col(f"a.{c}") for c in "xyz"], [F.col(f"b.{c}") for c in "xyz"])
    return d.select("graph_id", F.col("a.node_id").alias("src"), F.col("b.node_id").alias("dst"), length.alias("distance"))


def _bond_channels(bonds: DataFrame, mode: str) -> DataFrame:
    """Rows of the bonds' own channels, both ways, made in one pass over the bonds."""
    cell = lambda channel, value: F.struct(channel.cast("int").alias("channel"), value.cast("double").alias("value"))
    cells: list[Column] = [cell(F.col("type_number") - 1, (F.col("type_number") <= 4).cast("int"))]
    if mode == "length":
        cells.append(cell(F.lit(4), F.col("length")))
    if mode in ("ring", "all", "allbins"):
        cells += [cell(F.lit(4), F.col("is_conjugated").cast("int")), cell(F.lit(5), F.col("is_ring").cast("int"))]
    ends = F.array(F.struct(F.col("begin").alias("src"), F.col("end").alias("dst")), F.struct(F.col("end").alias("src"), F.col("begin").alias("dst")))
    d = bonds.select("graph_id", F.explode(ends).alias("e"), F.array(*cells).alias("c")).select("graph_id", "e.src", "e.dst", F.explode("c").alias("c"))
    return d.select("graph_id", "src", "dst", "c.channel", "c.value").where("value <> 0")


def adjacency_channels(nodes: DataFrame, bonds: DataFrame, name: str = "OnlyCovalentBond") -> DataFrame:
    """The non-zero channels of the valid graphs."""
    mode = mode_of(name)
    out = _bond_channels(bonds, mode)
    if mode in ("distance", "all", "bins", "allbins"):
        base = 4 if mode in ("distance", "bins") else 6
        d = node_distances(nodes)
        channel, value = (F.lit(base), F.col("distance")) if mode in ("distance", "all") else (F.lit(base) + distance_bin(F.col("distance")), F.lit(1.0))
        out = out.unionByName(d.select("graph_id", "src", "dst", channel.cast("int").alias("channel"), value.alias("value")).where("value <> 0"))
    if mode in STRICT:
        out = out.join(invalid_graphs(bonds, name), "graph_id", "left_anti")
    return out


def pair_channels(
    graphs: DataFrame, atoms: DataFrame, mol_bonds: DataFrame, nodes: DataFrame, bonds: DataFrame, name: str = "OnlyCovalentBond",
    hbond: bool = True, pipi_stack: bool = False, contact: bool = False,
) -> DataFrame:
    """Channels of pair graphs, the interactions that are on appended behind those of the mode."""
    base = adjacency_channels(nodes, bonds, name)
    more = interaction_channels(graphs, atoms, mol_bonds, CHANNELS[mode_of(name)], hbond, pipi_stack, contact)
    if more is None:
        return base
    return base.unionByName(more.join(invalid_graphs(bonds, name), "graph_id", "left_anti"))


def to_edges(channels: DataFrame, n_channels: int) -> DataFrame:
    """graph_id, src, dst, edge_attr: the pairs whose channels' sum isn't 0, with all channels as an array of floats."""
    cells = [F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("value"))), F.lit(0.0)) for c in range(n_channels)]
    d = channels.groupBy("graph_id", "src", "dst").agg(F.sum("value").alias("_sum"), F.array(*cells).cast("array<float>").alias("edge_attr"))
    return d.where("_sum <> 0").drop("_sum")
