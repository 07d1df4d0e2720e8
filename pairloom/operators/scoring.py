"""From pairs of keys, or of structures, to scores in one call, with an error for each pair that has none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import argmax, class_name
from ..sources import lookups, molblocks, smiles
from ..sources.shared import spread, written
from . import assembly, network, perception
from .adjacency import BONDS_ONLY, mode_of


#: Pairs a key is in, on average, from which sums of molecules are stored.
SEVERAL = 4


def score_pairs(
    pairs: DataFrame, atoms: DataFrame, bonds: DataFrame | None, params: network.Params, mode: str = "OnlyCovalentBond", pad_to: int | None = None
) -> DataFrame:
    """graph_id, key1, key2, probs, pred, class and error of every row of pairs (graph_id, key1, key2; no label is needed).

    probs is the mean over both orders of a pair. error says why a pair has no scores: a key without atoms, atoms or
    bonds outside the vocabularies, or more nodes than pad_to; it is null for the others. graph_id tells pairs apart.

    Where edges are bonds and molecules are in several pairs, the convolutions see each molecule once; its sums, which are many times as large as
    itself, are written to the shared folder. Where a key is in fewer than SEVERAL pairs on average, pairs meet the molecules themselves, and with
    distances, which join both molecules, every pair is a graph of its own. bonds None: see `assembly.molecule_samples`.
    """
    if mode_of(mode) in BONDS_ONLY:
        keys = pairs.select(F.explode(F.array("key1", "key2")).alias("key")).agg(F.count("key"), F.approx_count_distinct("key")).first()
        if keys[0] < SEVERAL * keys[1]:
            return _from_molecules(pairs.select("graph_id", "key1", "key2"), assembly.molecule_samples(atoms, bonds, mode), params, pad_to)
        known = written(network.sums(assembly.molecule_samples(atoms, bonds, mode), params, ("n",)).withColumn("reason", F.lit(None).cast("string")))
        return _from_sums(pairs.select("graph_id", "key1", "key2"), known, params, pad_to).drop("n1", "n2")
    given = pairs.select("graph_id", "key1", "key2")
    whole = given.select("graph_id", "key1", "key2", F.lit(0).alias("label"), F.lit("").alias("tag"), F.lit("").alias("last"))
    data = assembly.build_dataset(whole, atoms, bonds, mode, strict=False, denied=[])
    rows = assembly.samples(data)
    if pad_to is not None:
        rows = rows.where(F.col("n") <= pad_to)
    scored = network.both_orders(rows, params, pad_to)
    known = atoms.groupBy(F.col("mol_key").alias("key1")).agg(F.count(F.lit(1)).alias("n1"))
    d = given.join(known, "key1", "left").join(known.select(F.col("key1").alias("key2"), F.col("n1").alias("n2")), "key2", "left").join(scored, "graph_id", "left")
    missing = lambda k: F.when(F.col(f"n{k}").isNull(), F.concat(F.lit("no molecule: "), F.coalesce(F.col(f"key{k}").cast("string"), F.lit("null"))))
    too_large = F.when(F.col("n1") + F.col("n2") > (pad_to or 1 << 62), F.lit("more nodes than the padded size"))
    other = F.when(F.col("pred").isNull(), F.lit("atoms or bonds outside the vocabularies"))
    error = F.coalesce(missing(1), missing(2), too_large, other)
    return d.select("graph_id", "key1", "key2", "probs", "pred", class_name(F.col("pred")).alias("class"), error.alias("error"))


def _from_sums(pairs: DataFrame, known: DataFrame, params: network.Params, pad_to: int | None) -> DataFrame:
    """pairs (with key1, key2) and n1, n2, probs, pred, class and error, from known: mol_key, n, total and reason (why there is no molecule) of every key."""
    side = lambda k: known.select(*[F.col(c).alias(f"{name}{k}") for c, name in (("mol_key", "key"), ("n", "n"), ("total", "total"), ("reason", "reason"))])
    d = pairs.join(side(1), "key1", "left").join(side(2), "key2", "left").withColumn("n", F.col("n1") + F.col("n2"))
    d = network.from_sums(d, params, pad_to)
    return _with_errors(d, pairs.columns, pad_to)


def _from_molecules(pairs: DataFrame, molecules: DataFrame, params: network.Params, pad_to: int | None) -> DataFrame:
    """_from_sums without n1 and n2, from rows of `assembly.molecule_samples`, convolved with each pair they are in."""
    side = lambda k: molecules.select(F.col("mol_key").alias(f"key{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("n", "x", "src", "dst")])
    d = pairs.join(side(2), "key2", "left").join(side(1), "key1", "left").withColumn("n", F.col("n1") + F.col("n2"))
    fits = F.col("x1").isNotNull() & F.col("x2").isNotNull() & (F.col("n") <= (pad_to or 1 << 62))
    moved = lambda c: F.concat(f"{c}1", F.transform(f"{c}2", lambda i: i + F.col("n1"))).alias(c)
    d = d.select("graph_id", "key1", "key2", "n1", "n2", "n", F.when(fits, F.concat("x1", "x2")).alias("x"), moved("src"), moved("dst"))
    d = network.probabilities(network.logits(d, params, pad_to, keep=("key1", "key2", "n1", "n2", "n")))
    none = F.lit(None).cast("string")
    known = F.col("logits").isNotNull()
    d = d.withColumns({"probs": F.when(known, F.col("probs")), "pred": F.when(known, argmax(F.col("probs"))), "reason1": none, "reason2": none})
    return _with_errors(d, pairs.columns, pad_to).drop("n1", "n2")


def _with_errors(d: DataFrame, columns: list[str], pad_to: int | None) -> DataFrame:
    told = [F.concat(F.lit(f"{word} input: "), f"reason{k}") for k, word in ((1, "first"), (2, "second"))]
    missing = lambda k: F.when(F.col(f"n{k}").isNull(), F.concat(F.lit("no molecule: "), F.coalesce(F.col(f"key{k}").cast("string"), F.lit("null"))))
    too_large = F.when(F.col("n") > (pad_to or 1 << 62), F.lit("more nodes than the padded size"))
    other = F.when(F.col("pred").isNull(), F.lit("atoms or bonds outside the vocabularies"))
    error = F.coalesce(*told, missing(1), missing(2), too_large, other)
    return d.select(*columns, "n1", "n2", "probs", "pred", class_name(F.col("pred")).alias("class"), error.alias("error"))


#: What an input of `score_structures` may be.
INPUTS = ("smiles", "cas", "mol_block", "sdf")


def structures(
    inputs: DataFrame, kind: str = "smiles", tiers: list[DataFrame] | None = None, resolver: Callable[[str], str | None] | None = None, blocks: DataFrame | None = None
) -> DataFrame:
    """Perceived molecule rows, by key, of inputs (mol_key, input). An input without a structure has an error in its row.

    smiles: strings. cas: registry numbers; their strings come from `tiers` (tables of cas, value) or the resolver. mol_block: the
    blocks themselves. sdf: keys of `blocks` (mol_key, block), such as `molblocks.read_records` or `read_mol_blocks` give. Hydrogens of
    strings become atoms; blocks keep the atoms they have.
    """
    if kind not in INPUTS:
        raise ValueError(f"unknown kind of input: {kind}; known are {', '.join(INPUTS)}")
    if kind in ("mol_block", "sdf"):
        found = inputs.select("mol_key", F.col("input").alias("block"))
        if kind == "sdf":
            found = inputs.join(blocks.select(F.col("mol_key").alias("input"), "block"), "input", "left").select("mol_key", "block")
        return perception.perceived(molblocks.rows(found.withColumn("block", F.coalesce("block", F.lit("")))), hydrogens=False)
    if kind == "cas":
        known = lookups.resolve(inputs.withColumnRenamed("input", "cas"), "cas", tiers or [], resolver=resolver)
        made = smiles.rows(known.where("value IS NOT NULL"), text="value")
        none = known.where("value IS NULL").select("mol_key", F.concat(F.lit("no structure is known for "), F.coalesce("cas", F.lit("null"))).alias("error"))
        made = made.unionByName(none, allowMissingColumns=True)
    else:
        made = smiles.rows(inputs, text="input")
    return perception.perceived(made, hydrogens=True)


def score_structures(
    pairs: DataFrame, params: network.Params, kind: str = "smiles", mode: str = "OnlyCovalentBond", pad_to: int | None = None, **source
) -> DataFrame:
    """graph_id, input1, input2, n1, n2, probs, pred, class and error of pairs (graph_id, input1, input2), from structures to scores in one call.

    Each distinct input is read and perceived once, and written to the shared folder; see `structures` for kinds and sources. error
    tells which of the two inputs can't be used and why, or what `score_pairs` says; the other pairs are scored. Modes with distances
    need coordinates, so blocks.
    """
    key = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256)
    given = written(pairs.select("graph_id", "input1", "input2", key("input1").alias("key1"), key("input2").alias("key2")))
    inputs = given.select(F.explode(F.array("input1", "input2")).alias("input")).distinct().groupBy(key("input").alias("mol_key")).agg(F.first("input").alias("input"))
    made = written(structures(spread(inputs), kind, **source))
    atoms, bonds = perception.atom_table(made), perception.bond_table(made)
    if mode_of(mode) in BONDS_ONLY:
        facts = made.select("mol_key", F.when(F.col("error").isNull(), F.size("atoms")).alias("n"), F.col("error").alias("reason"))
        known = written(facts.join(network.sums(assembly.molecule_samples(atoms, bonds, mode), params), "mol_key", "left"))
        return _from_sums(given, known, params, pad_to).drop("key1", "key2").select("graph_id", "input1", "input2", "n1", "n2", "probs", "pred", "class", "error")
    scored = score_pairs(given, atoms, bonds, params, mode, pad_to)
    d = given.join(scored.drop("key1", "key2"), "graph_id")
    for side, word in ((1, "first"), (2, "second")):
        facts = made.select(F.col("mol_key").alias(f"key{side}"), F.size("atoms").alias(f"n{side}"), F.concat(F.lit(f"{word} input: "), "error").alias(f"error{side}"))
        d = d.join(facts, f"key{side}", "left")
    error = F.coalesce("error1", "error2", "error")
    return d.select("graph_id", "input1", "input2", *[F.when(F.col(f"error{s}").isNull(), F.col(f"n{s}")).alias(f"n{s}") for s in (1, 2)], "probs", "pred", "class", error.alias("error"))
