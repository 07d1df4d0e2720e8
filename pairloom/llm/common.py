"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"
IN_WORD = r"[^\x20\x09-\x0D]"


#: Rows of an Arrow batch: whole texts, so fewer than Spark's default.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory that a batch of whole texts takes, on both sides of the pipe to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, else (local sessions only) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets the planner choose joins by the
    real size of the files.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/pairloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more, such as those of an earlier round of a loop."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Ids that are broadcast at most (some 16 MB); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows with (how: left_semi) or without (left_anti) the doc_ids of a settled table of ids.

    Texts stay where they are as long as the ids are few enough to be broadcast, which their count tells.
    """
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, "doc_id", how)


def computed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, computed before any filter that follows.

    Catalyst moves a filter below a projection by writing the column's whole expression into the filter, where
    a lambda then computes the arrays it reads anew for every element. It moves none below a generator.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def words_of(text: Column) -> Column:
    """Words of a text without nulls, as an array."""
    return F.array_remove(F.split(text, GAP, -1), "")


def unit_interval(key: Column) -> Column:
    """A number in [0, 1) from the md5 of a key (null: an empty one): the same on every run and in other SQL engines."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
