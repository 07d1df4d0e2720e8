"""Lookups with fallbacks, such as from registry numbers to structures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(
    rows: DataFrame, key: str, tiers: list[DataFrame], value: str = "value", resolver: Callable[[str], str | None] | None = None
) -> DataFrame:
    """rows with `value`: that of the first tier (tables of key, value) that has the key, else the resolver's, else null.

    The resolver (off by default, for example a network service) is asked once for each key that no tier has;
    what it raises counts as null.
    """
    d = rows
    for i, t in enumerate(tiers):
        d = d.join(t.select(F.col(key), F.col(value).alias(f"_v{i}")), key, "left")
    known = F.coalesce(*[F.col(f"_v{i}") for i in range(len(tiers))]) if tiers else F.lit(None).cast("string")
    d = d.withColumn(value, known).drop(*[f"_v{i}" for i in range(len(tiers))])
    if resolver is None:
        return d

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch[key]:
                try:
                    out.append(resolver(k))
                except Exception:
                    out.append(None)
            yield pd.DataFrame({key: batch[key], "_asked": pd.Series(out, dtype="object")})

    missing = d.where(F.col(value).isNull() & F.col(key).isNotNull()).select(key).distinct()
    asked = missing.mapInPandas(ask, f"{key} {rows.schema[key].dataType.simpleString()}, _asked string")
    return d.join(asked, key, "left").withColumn(value, F.coalesce(value, "_asked")).drop("_asked")


def first_of(json: str, path: str):
    """A value out of a service's JSON answer."""
    return F.get_json_object(json, path)
