"""Datasets of pair graphs: validity, assembly, padding, splits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.features import N_FEATURES, allowed_atom, vertex_features
from ..sources.datasets import Dataset
from ..sources.pairs import checked_labels, without_denied
from ..sources.shared import written
from .adjacency import BONDS_ONLY, CHANNELS, adjacency_channels, invalid_graphs, mode_of, pair_channels, to_edges
from .pairs import pair_bonds, pair_graphs, pair_nodes


def valid_graphs(nodes: DataFrame) -> DataFrame:
    """graph_id of the graphs all of whose atoms have features in the vocabularies."""
    return nodes.groupBy("graph_id").agg(F.bool_and(allowed_atom()).alias("ok")).where("ok").select("graph_id")


def build_dataset(
    pairs: DataFrame, atoms: DataFrame, bonds: DataFrame, mode: str = "OnlyCovalentBond", hbond: bool = False, pipi_stack: bool = False,
    contact: bool = False, strict: bool = True, denied: list[str] | None = None,
) -> Dataset:
    """From pairs (graph_id, key1, key2, label, tag, last) to graphs, nodes and edges.

    Denied tags go first, then rows without a usable label, then graphs with atoms outside the vocabularies or
    bonds that the mode rejects. A molecule that is missing is an error if strict.
    """
    kept, _ = checked_labels(without_denied(pairs, denied))
    graphs = pair_graphs(kept, atoms, strict=strict)
    nodes = pair_nodes(graphs, atoms)
    own = pair_bonds(graphs, bonds)
    good = valid_graphs(nodes).join(invalid_graphs(own, mode), "graph_id", "left_anti")
    graphs = graphs.join(good, "graph_id", "left_semi")
    nodes, own = nodes.join(good, "graph_id", "left_semi"), own.join(good, "graph_id", "left_semi")
    channels = pair_channels(graphs, atoms, bonds, nodes, own, mode, hbond, pipi_stack, contact)
    edges = to_edges(channels, CHANNELS[mode_of(mode)] + hbond + pipi_stack + contact)
    return Dataset(
        graphs.select("graph_id", "name", "n1", "n2", "n", "label", "tag"), nodes.select("graph_id", "node_id", "side", vertex_features().alias("features")), edges
    )


def require_rows(df: DataFrame, message: str = "No valid data processed") -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def samples(data: Dataset) -> DataFrame:
    """One row a graph: its columns, features by node id, and src and dst of its edges. A graph is small by definition."""
    x = data.nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "features"))).alias("v"))
    e = data.edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("e"))
    d = data.graphs.join(x, "graph_id").join(e, "graph_id", "left")
    none = F.array().cast("array<int>")
    return d.select(*data.graphs.columns, F.col("v.features").alias("x"), F.coalesce("e.src", none).alias("src"), F.coalesce("e.dst", none).alias("dst"))


def _gathered(atoms: DataFrame, *more: Column, **found: Column) -> DataFrame:
    """mol_key, n, x (null if an atom is outside the vocabularies) and what else is found of each molecule's atoms and more columns of theirs."""
    # Behind a generator, since the group would evaluate what it collects uncompiled.
    made = F.struct(allowed_atom().alias("ok"), F.when(allowed_atom(), vertex_features()).alias("features"), *more)
    d = atoms.select("mol_key", "idx", F.inline(F.array(made))).groupBy("mol_key")
    vertices = F.sort_array(F.collect_list(F.struct("idx", "features"))).alias("v")
    d = d.agg(F.count(F.lit(1)).cast("int").alias("n"), F.bool_and("ok").alias("_ok"), vertices, *[c.alias(k) for k, c in found.items()])
    return d.select("mol_key", "n", F.when(F.col("_ok"), F.col("v.features")).alias("x"), *found)


def _both_ends(begin: Column, end: Column) -> Column:
    return F.array(*[F.struct(i.cast("int").alias("src"), j.cast("int").alias("dst")) for i, j in ((begin, end), (end, begin))])


def _molecule_edges(bonds: DataFrame, mode: str) -> DataFrame:
    """mol_key, e (src and dst of a molecule's edges, sorted) and bad (whether the mode rejects it)."""
    if mode_of(mode) == "covalent":  # every bond of a known type is an edge: one group a molecule
        known = F.collect_list(F.when(F.col("type_number") <= 4, F.struct("begin", "end")))
        g = bonds.groupBy("mol_key").agg(known.alias("b"), F.bool_or(F.col("type_number") > 4).alias("bad"))
        return g.select("mol_key", F.sort_array(F.array_distinct(F.flatten(F.transform("b", lambda b: _both_ends(b["begin"], b["end"]))))).alias("e"), "bad")
    e = to_edges(adjacency_channels(None, bonds.withColumnRenamed("mol_key", "graph_id"), mode), CHANNELS[mode_of(mode)])
    return e.groupBy(F.col("graph_id").alias("mol_key")).agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("e"), F.lit(False).alias("bad"))


def molecule_samples(atoms: DataFrame, bonds: DataFrame | None, mode: str = "OnlyCovalentBond", kinds: bool = False) -> DataFrame:
    """mol_key, n, x, src and dst of every molecule as a graph of its own (see `samples`); x is null where atoms or bonds are outside the vocabularies.

    For modes whose channels are those of bonds. Without bonds, atoms have them: links is each one's array of end and type_number, every
    bond at one of its atoms, for the mode OnlyCovalentBond; nothing is then joined. kinds: also src, dst and type of every bond.
    """
    if mode_of(mode) not in BONDS_ONLY or (bonds is None and mode_of(mode) != "covalent"):
        raise ValueError(f"edges of the mode {mode!r} are not those of the bonds given")
    if bonds is None:
        ends = F.flatten(F.transform(F.filter("links", lambda b: b["type_number"] <= 4), lambda b: _both_ends(F.col("idx"), b["end"])))
        bad = F.exists("links", lambda b: b["type_number"] > 4)
        types = F.transform("links", lambda b: F.struct(F.col("idx").cast("int").alias("src"), b["end"].cast("int").alias("dst"), b["type_number"].cast("int").alias("type"))).alias("types")
        more = {"kinds": F.flatten(F.collect_list("types"))} if kinds else {}
        d = _gathered(atoms, ends.alias("ends"), bad.alias("bad"), *[types] * kinds, e=F.sort_array(F.array_distinct(F.flatten(F.collect_list("ends")))), bad=F.bool_or("bad"), **more)
    else:
        d = _gathered(atoms).join(_molecule_edges(bonds, mode), "mol_key", "left")
    none = F.array().cast("array<int>")
    x = F.when(~F.coalesce("bad", F.lit(False)), F.col("x")).alias("x")
    return d.select("mol_key", "n", x, F.coalesce("e.src", none).alias("src"), F.coalesce("e.dst", none).alias("dst"), *["kinds"] * kinds)


def linked_dataset(pairs: DataFrame, atoms: DataFrame, denied: list[str] | None = None) -> Dataset:
    """build_dataset (not strict, OnlyCovalentBond) of atoms with links (see `molecule_samples`).

    Rows of pairs are made once and written to the shared folder; the tables are unfolded from them behind a deal of these rows in ranges.
    """
    rows = written(pair_samples(pairs, atoms, None, denied=denied, kinds=True)).repartitionByRange("graph_id").sortWithinPartitions("graph_id")
    nodes = rows.select("graph_id", "n1", F.posexplode("x").alias("node_id", "features"))
    side = F.when(F.col("node_id") < F.col("n1"), 1).otherwise(2).alias("side")
    e = rows.select("graph_id", "kinds", F.inline(F.arrays_zip("src", "dst")))
    own = F.filter("kinds", lambda b: ((b["src"] == F.col("src")) & (b["dst"] == F.col("dst"))) | ((b["src"] == F.col("dst")) & (b["dst"] == F.col("src"))))
    count = lambda k: F.size(F.filter(own, lambda b: b["type"] == k)).cast("float")
    cells = [count(k) for k in range(1, CHANNELS["covalent"] + 1)]
    edges = e.select("graph_id", "src", "dst", F.array(*cells).alias("edge_attr"))
    return Dataset(rows.select("graph_id", "name", "n1", "n2", "n", "label", "tag"), nodes.select("graph_id", "node_id", side, "features"), edges, ranged=True)


def pair_samples(pairs: DataFrame, atoms: DataFrame, bonds: DataFrame | None, mode: str = "OnlyCovalentBond", denied: list[str] | None = None, kinds: bool = False) -> DataFrame:
    """The `samples` of `build_dataset` (not strict, without interactions), for modes whose channels are those of bonds; see `molecule_samples`.

    No edge joins the two molecules then, so atoms and bonds are gathered by molecule, where they are, and pairs meet whole molecules: no table of
    nodes or edges is dealt by graph.
    """
    kept, _ = checked_labels(without_denied(pairs, denied))
    m = molecule_samples(atoms, bonds, mode, kinds).where("x IS NOT NULL")
    side = lambda i: m.select(F.col("mol_key").alias(f"key{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("n", "x", "src", "dst", *["kinds"] * kinds)])
    d = kept.select("graph_id", "key1", "key2", "label", "tag").join(side(2), "key2").join(side(1), "key1")
    moved = lambda c: F.concat(f"{c}1", F.transform(f"{c}2", lambda i: i + F.col("n1"))).alias(c)
    name = F.concat_ws("&", F.col("key1").cast("string"), F.col("key2").cast("string")).alias("name")
    typed = [F.concat("kinds1", F.transform("kinds2", lambda b: F.struct((b["src"] + F.col("n1")).alias("src"), (b["dst"] + F.col("n1")).alias("dst"), b["type"].alias("type")))).alias("kinds")] if kinds else []
    return d.select("graph_id", name, "n1", "n2", (F.col("n1") + F.col("n2")).alias("n"), "label", "tag", F.concat("x1", "x2").alias("x"), moved("src"), moved("dst"), *typed)


def reversed_samples(rows: DataFrame) -> DataFrame:
    """The same pairs (rows of `samples`) in the other order: the second graph's nodes come first."""
    # Under names of their own: in a lambda, n1 would be the n1 that the same select makes.
    rows_ = rows.withColumns({"_n1": F.col("n1").cast("int"), "_n2": F.col("n2").cast("int")})
    n1, n2 = F.col("_n1"), F.col("_n2")
    moved = lambda c: F.transform(c, lambda i: F.when(i < n1, i + n2).otherwise(i - n1).cast("int")).alias(c)
    x = F.concat(F.slice("x", n1 + 1, n2), F.slice("x", F.lit(1), n1)).alias("x")
    new = {"n1": F.col("n2").alias("n1"), "n2": F.col("n1").alias("n2"), "x": x, "src": moved("src"), "dst": moved("dst")}
    return rows_.select(*[new.get(c, F.col(c)) for c in rows.columns])


def node_mask(n: Column, node_id: Column) -> Column:
    return (node_id < n).cast("float")


def padded_nodes(graphs: DataFrame, nodes: DataFrame, length: int, width: int = N_FEATURES) -> DataFrame:
    """graph_id, node_id 0 to length-1, features (zeros behind the real nodes) and mask. A longer graph is an error."""
    too_long = F.raise_error(F.concat(F.lit("graph larger than the padded size: "), F.col("graph_id").cast("string"))).cast("int")
    last = F.when(F.col("n") <= length, F.lit(length - 1)).otherwise(too_long)
    slots = graphs.select("graph_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("node_id"))
    zeros = F.array_repeat(F.lit(0.0), width).cast("array<float>")
    d = slots.join(nodes.select("graph_id", "node_id", "features"), ["graph_id", "node_id"], "left")
    return d.select("graph_id", "node_id", F.coalesce("features", zeros).alias("features"), node_mask(F.col("n"), F.col("node_id")).alias("mask"))


def subgraph_size() -> Column:
    return F.array("n1", "n2")


def label_histogram(graphs: DataFrame, classes: int = 4) -> DataFrame:
    """label and count, with a row for each class."""
    every = graphs.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    counts = graphs.groupBy(F.col("label").cast("int").alias("label")).count()
    return every.join(counts, "label", "left").select("label", F.coalesce("count", F.lit(0)).alias("count"))


def is_validation(key: Column, seed: int = 42, tenths: int = 1) -> Column:
    """A fixed tenth of the rows: by the md5 of seed and key, whatever the order and number of rows."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long") % 10 < tenths


def split(rows: DataFrame, key: str = "graph_id", seed: int = 42, tenths: int = 1) -> tuple[DataFrame, DataFrame]:
    """Training rows and validation rows."""
    held = is_validation(F.col(key), seed, tenths)
    return rows.where(~held), rows.where(held)


def batches(rows: DataFrame, size: int, seed: int = 42, key: str = "graph_id", drop_last: bool = False) -> DataFrame:
    """rows with batch: a seeded shuffle (the order of md5 of seed and key) cut into batches of `size`.

    Rows are dealt to 4096 parts by the first digits of the md5 and numbered within them, behind the rows of the parts
    before, so no single task orders all rows. Only the last batch of all may be smaller; drop_last removes it.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    d = rows.withColumn("_part", F.substring(draw, 1, 3))
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy("_part").count()  # at most 4096 rows
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.sum("count").over(every).alias("_all"))
    d = d.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(draw, key)) - 1).join(F.broadcast(offsets), "_part")
    d = d.withColumn("_batch", F.floor((F.col("_before") + F.col("_place")) / size)).withColumn("batch", F.col("_batch").cast("string"))
    if drop_last:
        d = d.where((F.col("_batch") + 1) * size <= F.col("_all"))
    return d.drop("_part", "_batch", "_place", "_before", "_all")
