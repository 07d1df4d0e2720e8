"""Molecule blocks (V2000): name, atoms and bonds read with string functions.

`atoms` and `bonds` give what a block says; `rows` gives molecule rows, of which `operators.perception` derives the rest
(aromaticity, hybridisation, donors, rings, stereo). A block that holds many records is split by `read_records`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import ELEMENTS
from ..functions.features import euclidean, is_metal, type_number
from .rows import with_rings


def read_mol_blocks(spark: SparkSession, path: str) -> DataFrame:
    """mol_key (file name before its first dot) and block, one row a file."""
    name = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -1), ".", 1)
    return spark.read.option("wholetext", True).text(path).select(name.alias("mol_key"), F.col("value").alias("block"))


def _lines() -> Column:
    return F.col("_lines")


def _split(blocks: DataFrame) -> DataFrame:
    """blocks with their lines, split once: behind a generator, from which Catalyst copies no expression into those that read it."""
    return blocks.select(F.inline(F.array(F.struct("mol_key", "block", F.split("block", "\r?\n", -1).alias("_lines")))))


def _read(blocks: DataFrame) -> DataFrame:
    """molecules, with _lines, and _places and _bonds of the blocks that have enough lines; each is made once."""
    d = _split(blocks)
    counts = F.coalesce(F.get(_lines(), F.lit(3)), F.lit(""))
    name = F.trim(F.get(_lines(), F.lit(0)))
    d = d.select(F.inline(F.array(F.struct("mol_key", "block", "_lines", name.alias("name"), _number(counts, 1, 3, "int").alias("n_atoms"), _number(counts, 4, 3, "int").alias("n_bonds")))))
    enough = (F.col("n_atoms") > 0) & (F.col("n_bonds") >= 0) & (F.size(_lines()) >= 4 + F.col("n_atoms") + F.col("n_bonds"))
    ok = F.coalesce(enough, F.lit(False))
    made = F.struct("mol_key", "block", "_lines", "name", "n_atoms", "n_bonds", ok.alias("_ok"), F.when(ok, _places()).alias("_places"), F.when(ok, _bond_fields()).alias("_bonds"))
    d = d.select(F.inline(F.array(made)))
    placed = F.forall("_places", lambda a: a["x"].isNotNull() & a["y"].isNotNull() & a["z"].isNotNull())
    end = lambda e: F.coalesce((e >= 0) & (e < F.col("n_atoms")), F.lit(False))
    joined = F.forall("_bonds", lambda b: end(b["begin"]) & end(b["end"]))
    return d.withColumn("valid", F.col("_ok") & F.coalesce(placed & joined, F.lit(False))).drop("_ok")


def _number(line: Column, start: int, width: int, kind: str) -> Column:
    return F.trim(F.substring(line, start, width)).try_cast(kind)


def molecules(blocks: DataFrame) -> DataFrame:
    """mol_key, name (the block's first line), n_atoms, n_bonds, and valid: whether counts, coordinates and bonds can be read.

    A block that can't be read makes no error: it is not valid, and its molecule is missing from atoms and bonds.
    """
    return _read(blocks).drop("_lines", "_places", "_bonds")


def _places() -> Column:
    """The coordinates of a block's atoms."""
    lines = F.slice(_lines(), F.lit(5), F.col("n_atoms"))
    return F.transform(lines, lambda x: F.struct(*[_number(x, 1 + 10 * i, 10, "double").alias(c) for i, c in enumerate("xyz")]))


def _bond_fields() -> Column:
    lines = F.slice(_lines(), F.lit(5) + F.col("n_atoms"), F.col("n_bonds"))
    return F.transform(
        lines, lambda x: F.struct((_number(x, 1, 3, "int") - 1).alias("begin"), (_number(x, 4, 3, "int") - 1).alias("end"), _number(x, 7, 3, "int").alias("kind"))
    )


def atoms(blocks: DataFrame) -> DataFrame:
    """mol_key, idx (from 0), symbol, x, y, z, formalcharge, atomic_number, is_metal of the valid blocks."""
    m = _read(blocks).where("valid")
    charge_lines = F.filter(_lines(), lambda x: x.startswith("M  CHG"))
    numbers = F.flatten(F.transform(charge_lines, lambda x: F.slice(F.split(F.trim(F.substring(x, 10, 1000)), " +"), 1, 1000)))
    symbols = F.transform(F.slice(_lines(), F.lit(5), F.col("n_atoms")), lambda x: F.trim(F.substring(x, 32, 3)))
    d = m.select("mol_key", numbers.alias("numbers"), F.posexplode(F.arrays_zip(symbols.alias("symbol"), F.col("_places").alias("p"))).alias("idx", "a"))
    d = d.select("mol_key", "idx", "a.symbol", "a.p.*", "numbers", F.size("numbers").alias("n"))
    last = "array_max(filter(sequence(0, n - 2, 2), i -> get(numbers, i) = cast(idx + 1 AS string)))"
    charge = F.when(F.col("n") >= 2, F.expr(f"try_cast(get(numbers, {last} + 1) AS int)"))
    number = F.nullif(F.array_position(F.array(*[F.lit(e) for e in ELEMENTS]), F.col("symbol")), F.lit(0)).cast("int")
    d = d.withColumn("formalcharge", F.coalesce(charge, F.lit(0))).withColumn("atomic_number", number)
    return d.select("mol_key", "idx", "symbol", "x", "y", "z", "formalcharge", "atomic_number", F.coalesce(is_metal(F.col("atomic_number")), F.lit(False)).alias("is_metal"))


def bonds(blocks: DataFrame) -> DataFrame:
    """mol_key, begin, end (from 0), bond_type, type_number and length of the valid blocks.

    Both ends of a bond are in the block's own row, so nothing is joined.
    """
    m = _read(blocks).where("valid AND n_bonds > 0").select("mol_key", F.col("_places").alias("p"), F.col("_bonds").alias("b"))
    placed = F.transform("b", lambda b: F.struct(b["begin"].alias("begin"), b["end"].alias("end"), b["kind"].alias("kind"), F.get("p", b["begin"]).alias("f"), F.get("p", b["end"]).alias("t")))
    b = m.select("mol_key", F.inline(placed))
    names = F.array(F.lit("SINGLE"), F.lit("DOUBLE"), F.lit("TRIPLE"), F.lit("AROMATIC"))
    b = b.withColumn("bond_type", F.coalesce(F.get(names, F.col("kind") - 1), F.lit("OTHER")))
    length = euclidean([F.col(f"f.{x}") for x in "xyz"], [F.col(f"t.{x}") for x in "xyz"])
    return b.select("mol_key", "begin", "end", "bond_type", type_number(F.col("bond_type")).alias("type_number"), length.alias("length"))


def rows(blocks: DataFrame) -> DataFrame:
    """Molecule rows of blocks (mol_key, block): all atoms with coordinates, bonds by order. Hydrogens are those of the block; what a valence leaves open stays implicit."""
    m = _read(blocks)
    symbols = F.transform(F.slice(_lines(), F.lit(5), F.col("n_atoms")), lambda x: F.trim(F.substring(x, 32, 3)))
    m = m.select("mol_key", "valid", F.when(F.col("valid"), symbols).alias("symbols"), F.when(F.col("valid"), _charges()).alias("charges"), F.when(F.col("valid"), F.col("_places")).alias("places"), F.when(F.col("valid"), F.col("_bonds")).alias("fields"))
    numbers = F.array(*[F.lit(e) for e in ELEMENTS])
    m = m.withColumn("numbers", F.transform("symbols", lambda s: F.array_position(numbers, s).cast("int")))
    kinds = "transform(fields, b -> named_struct('begin', b.begin, 'end', b.end, 'order', b.kind))"
    atoms_ = """transform(symbols, (s, i) -> named_struct('symbol', s, 'number', numbers[i], 'charge', coalesce(get(filter(charges, c -> c.atom = i + 1), size(filter(charges, c -> c.atom = i + 1)) - 1).charge, 0), 'isotope', 0, 'hs', -1, 'tag', '',
      'around', cast(array() AS array<int>), 'x', places[i].x, 'y', places[i].y, 'z', places[i].z))"""
    error = (
        F.when(~F.col("valid"), "the block can't be read")
        .when(F.array_contains("numbers", 0), "an unknown element")
        .when(F.exists("fields", lambda b: ~F.coalesce(b["kind"].between(1, 4), F.lit(False))), "a bond of unknown order")
    )
    return with_rings(m.select("mol_key", error.alias("error"), F.expr(atoms_).alias("atoms"), F.expr(kinds).alias("bonds")))


def _charges() -> Column:
    """Atom numbers (from 1) and charges of the block's charge lines."""
    lines = F.filter(_lines(), lambda x: x.startswith("M  CHG"))
    numbers = F.flatten(F.transform(lines, lambda x: F.transform(F.split(F.trim(F.substring(x, 10, 1000)), " +"), lambda n: n.try_cast("int"))))
    places = F.transform(F.filter(F.transform(numbers, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda p: (p["i"] % 2 == 0) & p["v"].isNotNull()), lambda p: p["i"])
    return F.transform(places, lambda i: F.struct(F.get(numbers, i).alias("atom"), F.coalesce(F.get(numbers, i + 1), F.lit(0)).alias("charge")))


def read_records(spark: SparkSession, path: str, key: str | None = None, ending: str = "$$$$\n") -> DataFrame:
    """mol_key and block of every record of files of many records (SDF), which are split wherever a record ends: no file is read whole.

    The key is the record's first line, or `key`, an SQL expression over `block`. `ending` is the line between records as it is
    written, with \\r\\n where files have it. A record's data fields stay in the block, behind its `M  END`.
    """
    d = spark.read.option("lineSep", ending).text(path).select(F.col("value").alias("block")).where("trim(block) != ''")
    return d.select((F.expr(key) if key else F.trim(F.get(F.split("block", "\r?\n", -1), F.lit(0)))).alias("mol_key"), "block")
