"""Featurised datasets: the tables graphs, nodes and edges as Parquet, predictions as CSV, and import of .npz archives."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import CLASS_NAMES
from .shared import released


@dataclass
class Dataset:
    """graphs (graph_id, n1, n2, n, label, tag), nodes (graph_id, node_id, features), edges (graph_id, src, dst, edge_attr)."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    #: Whether all three are in ranges of graph_id already, sorted by it.
    ranged: bool = False


def save(data: Dataset, path: str) -> None:
    """All three tables are written in ranges of graph_id, sorted by it: a filter on graph_id reads few files and row groups."""
    with released(data.graphs.sparkSession):  # one table's shuffle files at a time
        for name in ("graphs", "nodes", "edges"):
            rows = getattr(data, name)
            rows = rows if data.ranged else rows.repartitionByRange("graph_id").sortWithinPartitions("graph_id")
            rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Dataset:
    return Dataset(*[spark.read.parquet(f"{path}/{name}") for name in ("graphs", "nodes", "edges")])


def resolve(spark: SparkSession, path: str, build: Callable[[], Dataset] | None = None, rebuild: bool = False) -> Dataset:
    """The stored dataset if there is one and no rebuild is asked for; else what `build` makes, stored first."""
    if not rebuild:
        try:
            return load(spark, path)
        except AnalysisException as e:
            if build is None:
                raise FileNotFoundError(f"no dataset at {path}, and nothing to build it from") from e
    if build is None:
        raise FileNotFoundError(f"nothing to rebuild {path} from")
    save(build(), path)
    return load(spark, path)


#: A graph of an archive in a row.
GRAPH_ROW = "graph_id string, n1 int, n2 int, n int, label int, tag string, x array<array<float>>, src array<int>, dst array<int>, attr array<array<float>>"


def graph_row(graph_id: str, z: Mapping[str, np.ndarray], i: int) -> dict:
    """Row i of an archive's arrays. Padding goes; an edge is a pair of nodes whose channels' sum isn't 0."""
    v, a, n = z["V"], z["A"], int(z["graph_size"][i])
    src, dst = np.nonzero(a[i].sum(axis=1))
    n1, n2 = z["subgraph_size"][i].tolist() if "subgraph_size" in z else (None, None)
    return {
        "graph_id": graph_id, "n1": n1, "n2": n2, "n": n, "label": int(z["labels"][i]), "tag": str(z["tags"][i]), "x": v[i, :n].astype("float32").tolist(),
        "src": src.tolist(), "dst": dst.tolist(), "attr": a[i][src, :, dst].astype("float32").tolist(),
    }


def tables_of(rows: DataFrame) -> Dataset:
    """The three tables of graphs in rows."""
    nodes = rows.select("graph_id", F.posexplode("x").alias("node_id", "features"))
    edges = rows.select("graph_id", F.explode(F.arrays_zip("src", "dst", "attr")).alias("e")).select("graph_id", "e.src", "e.dst", F.col("e.attr").alias("edge_attr"))
    return Dataset(rows.select("graph_id", "n1", "n2", "n", "label", "tag"), nodes, edges)


def read_npz(spark: SparkSession, path: str) -> Dataset:
    """The tables of one or more .npz archives, each read whole in one task, from any store that Spark reads (pickled members are refused).

    graph_id is file name and place. `npz.read` takes large archives, by ranges.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                archive = np.load(io.BytesIO(content), allow_pickle=False)
                z = {k: archive[k] for k in archive.files if k in ("V", "A", "graph_size", "labels", "tags", "subgraph_size")}
                for i in range(len(z["graph_size"])):
                    yield pd.DataFrame({k: [x] for k, x in graph_row(f"{name.rsplit('/', 1)[-1]}#{i}", z, i).items()})

    return tables_of(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, GRAPH_ROW))


def prediction_rows(scored: DataFrame) -> DataFrame:
    """The result table: true and predicted label, whether they agree, and the classes' probabilities."""
    probs = [F.get("probs", F.lit(i)).alias(f"P({name})") for i, name in enumerate(CLASS_NAMES)]
    return scored.select(
        F.col("label").alias("True Label"), F.col("pred").alias("Predicted Label"), (F.col("label") == F.col("pred")).alias("Correct"), *probs
    )


def write_predictions(scored: DataFrame, path: str) -> None:
    prediction_rows(scored).write.mode("overwrite").option("header", True).csv(path)
