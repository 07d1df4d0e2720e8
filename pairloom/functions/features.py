"""Features of atoms and bonds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and orders of the 34 node features, of bond types and of distance bins.
SYMBOLS = ["Cl", "N", "P", "Br", "B", "S", "I", "F", "C", "O", "H"]
HYBRIDIZATIONS = ["SP2", "SP3", "SP", "S", "SP3D", "SP3D2"]
CHIRALITIES = ["", "R", "S"]
SCALARS = [
    "is_chiral", "is_spiro", "is_cyclic", "is_aromatic", "is_donor", "is_acceptor", "degree", "vdw_radius",
    "explicitvalence", "implicitvalence", "totalnumHs", "formalcharge", "radical_electrons", "atomic_number",
]
BOND_TYPES = ["SINGLE", "DOUBLE", "TRIPLE", "AROMATIC"]
BIN_EDGES = [2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0]
METAL_RANGES = [(3, 4), (11, 13), (19, 31), (37, 50), (55, 83), (87, 118)]
CLASS_NAMES = ["negative", "salt", "cocrystal", "solvate"]

ONE_HOT = {"symbol": SYMBOLS, "hybridization": HYBRIDIZATIONS, "chirality": CHIRALITIES}
N_FEATURES = sum(map(len, ONE_HOT.values())) + len(SCALARS)


def _values(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def one_hot(value: Column, allowed: list[str]) -> Column:
    """An array with 1 at the value's place; see `allowed_atom` for values outside."""
    return F.array(*[(value == F.lit(v)).cast("double") for v in allowed])


def allowed_atom() -> Column:
    """Whether the values of an atom's one-hot features are in their vocabularies (false for nulls)."""
    ok = F.lit(True)
    for name, values in ONE_HOT.items():
        ok &= F.coalesce(F.col(name).isin(values), F.lit(False))
    return ok


def vertex_features() -> Column:
    """The 34 features of an atom, from columns of their names; float, as they are stored."""
    parts = [one_hot(F.col(name), values) for name, values in ONE_HOT.items()]
    scalars = F.array(*[F.col(c).cast("double") for c in SCALARS])
    return F.concat(*parts, scalars).cast("array<float>")


def bare_hybridization(value: Column) -> Column:
    """Unspecified hybridization reads as S."""
    return F.when(value == "UNSPECIFIED", "S").otherwise(value)


def is_metal(atomic_number: Column) -> Column:
    ok = F.lit(False)
    for lo, hi in METAL_RANGES:
        ok |= atomic_number.between(lo, hi)
    return ok


def type_number(bond_type: Column) -> Column:
    """1 to 4 for the listed bond types, else 5."""
    at = F.array_position(_values(BOND_TYPES), bond_type)
    return F.coalesce(F.nullif(at, F.lit(0)), F.lit(5)).cast("int")


def euclidean(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def distance_bin(distance: Column) -> Column:
    """0 below 2, then steps of 0.5 up to 6, then 9; NaN is 9."""
    chain = F.when(F.isnan(distance), 9)
    for i, edge in enumerate(BIN_EDGES):
        chain = chain.when(distance < edge, i)
    return chain.otherwise(len(BIN_EDGES))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def argmax(values: Column) -> Column:
    """The place (from 0) of the largest value, of the first if several."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_name(index: Column) -> Column:
    return F.get(_values(CLASS_NAMES), index)


def report_line(name: Column, share: Column, chosen: Column, width: int = 30) -> Column:
    """A line of a console report: name, bar, percent, and a mark at the chosen class."""
    filled = F.floor(share * width).cast("int")
    bar = F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled))
    mark = F.when(chosen, " <--").otherwise("")
    return F.concat(F.lit("  "), F.lpad(name, 17, " "), F.lit("  ["), bar, F.lit("] "), F.format_string("%6.2f%%", share * 100), mark)


def strip_charges(text: Column) -> Column:
    """A molfile text without its charge lines; a charge column at a line's end that follows six spaces reads 0."""
    kept = F.filter(F.split(text, "\n", -1), lambda line: ~line.startswith("M  CHG"))
    spaced = lambda line: F.substring(line, -7, 6) == "      "
    return F.array_join(
        F.transform(kept, lambda line: F.when(spaced(line), F.concat(F.substring(line, F.lit(1), F.length(line) - 1), F.lit("0"))).otherwise(line)), "\n"
    )
