"""Sharding by balanced label propagation under row quotas.

Documents that share a link key (by default: equal texts) are linked. Every document starts in a
shard drawn from its id. Then, again and again, the members of a key count their shards (summed
before the shuffle), and members outside the key's best shard ask to move there: the one with most
members of those with room for the others; one more shard, drawn anew each round, is a candidate
too. A shard takes only as many as its quota has room for. This ends when no member asks to move, or when a round
has, for `PATIENCE` rounds, not brought down the number of those that do. Then an exact step makes the counts of all shards
equal or one apart: full shards give up documents, unlinked ones first, and the others take them.

Law: `rows`. A group of links larger than a shard is cut; so may be a group that no shard has room for, or
that the exact step takes documents from. `cut_groups` counts them.

Only numbers per shard (a parameter, not data) reach the driver. Ranks within a shard are taken in
buckets of ids whose sizes are then summed, so no shard's rows meet in one task.

Edge cases: a null text counts as empty (size 8, checksum 0), and null and empty texts are linked.
A null doc_id is drawn like any other value. Repeated rows are separate documents that are linked.
With fewer documents than shards, some shards stay empty. An empty table gives an empty result.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, settle, table

SHARDS, SLACK = 24, 0.25
#: Rounds without fewer members that ask to move after which propagation ends.
PATIENCE = 4
#: Rows of a shard that one bucket of its ranking may hold, on average.
BUCKET_ROWS = 500_000


def _ranked(df: DataFrame, by: str, first: Column, buckets: int) -> DataFrame:
    """Adds `rank` (from 0) within each value of `by`; rows with a smaller `first` (0 or 1) come first."""
    d = df.withColumn("_b", first.cast("int") * buckets + F.pmod(F.xxhash64("doc_id", "key", "_row"), F.lit(buckets)).cast("int"))
    counts = d.groupBy(by, "_b").count()
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy(by, "_b").orderBy("key", "doc_id", "_row")
    d = d.withColumn("_r", F.row_number().over(within) - 1)
    return d.join(offsets, [by, "_b"]).withColumn("rank", F.col("_o") + F.col("_r")).drop("_o", "_r", "_b")


def _lookup(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), index)


def _counts(df: DataFrame, column: str, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def balanced_label_propagation(
    nodes: DataFrame, shards: int = SHARDS, slack: float = SLACK, patience: int = PATIENCE
) -> DataFrame:
    """nodes: doc_id, key (equal keys link) and any more columns. Adds shard (int) and slot (long)."""
    columns = nodes.columns
    sizes = settle(nodes.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("linked")), "linked")
    start = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(shards)).cast("int")
    d = nodes.join(sizes, "key", "left").fillna(False, ["linked"]).withColumn("shard", start)
    d = settle(d.withColumn("_row", F.monotonically_increasing_id()), "labels")  # tells repeated rows apart, and stays as it is written
    counts = _counts(d, "shard", shards)
    total = sum(counts)
    buckets = max(16, total // (shards * BUCKET_ROWS))
    quota = int(total / shards * (1 + slack)) + 1
    history: list[int] = []
    turn = 0
    while True:
        room = [max(0, quota - c) for c in counts]
        votes = d.where("linked").groupBy("key", "shard").count()
        drawn = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(shards)).cast("int").alias("shard")
        votes = votes.unionByName(votes.groupBy("key").agg(F.lit(0).cast("long").alias("count")).select("key", drawn, "count"))
        everyone = votes.groupBy("key").agg(F.sum("count").alias("all"), F.collect_list(F.struct("shard", "count")).alias("v"))
        rated = F.transform(
            "v",
            lambda x: F.struct(
                (F.col("all") - x["count"] <= _lookup(room, x["shard"])).alias("fits"),
                x["count"].alias("count"),
                F.xxhash64("key", x["shard"]).alias("tie"),
                x["shard"].alias("shard"),
            ),
        )
        best = everyone.select("key", F.array_max(rated)["shard"].alias("target"))
        wish = d.join(settle(best, "votes"), "key", "left").withColumn("moving", F.coalesce(F.col("target") != F.col("shard"), F.lit(False)))
        wish = settle(wish, "wishes")
        # Members outside their key's best shard: what is left to do. It cannot fall for ever, so this ends.
        history.append(wish.where("moving").count())
        if not history[-1] or len(history) > patience and min(history[-patience:]) >= min(history[:-patience]):
            discard(wish)
            break
        movers = _ranked(wish.where("moving"), "target", F.lit(0), buckets)
        taken = F.when(F.col("rank") < _lookup(room, F.col("target")), F.col("target")).otherwise(F.col("shard"))
        moved = movers.withColumn("shard", taken.cast("int"))
        old, d = d, settle(wish.where("NOT moving").select(*d.columns).unionByName(moved.select(*d.columns)), "labels")
        counts, turn = _counts(d, "shard", shards), turn + 1
        discard(old), discard(wish)
    # Exact quotas: the fullest shards get the rows that are left over.
    order = sorted(range(shards), key=lambda s: (-counts[s], s))
    goal = [total // shards] * shards
    for s in order[: total % shards]:
        goal[s] += 1
    spare = [max(0, c - g) for c, g in zip(counts, goal)]
    if sum(spare):
        ranked = settle(_ranked(d, "shard", F.col("linked"), buckets), "ranked")
        before = [sum(spare[:s]) for s in range(shards)]
        ends, takers = [], [s for s in range(shards) if goal[s] > counts[s]]
        for s in takers:
            ends.append((ends[-1] if ends else 0) + goal[s] - counts[s])
        place = _lookup(before, F.col("shard")) + F.col("rank")
        taker = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("_p")))
        out = ranked.withColumn("_p", F.when(F.col("rank") < _lookup(spare, F.col("shard")), place))
        shard = F.when(F.col("_p").isNotNull(), _lookup(takers, taker)).otherwise(F.col("shard")).cast("int")
        d = settle(out.withColumn("shard", shard).select(*d.columns), "labels")
    return _ranked(d, "shard", F.lit(0), buckets).select(*columns, "shard", F.col("rank").alias("slot"))


def cut_groups(sharded: DataFrame) -> DataFrame:
    """key, n and n_shards of the groups of links that are in more than one shard."""
    parts = sharded.groupBy("key", "shard").count()
    return parts.groupBy("key").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_shards")).where("n_shards > 1")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    nodes = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    return balanced_label_propagation(nodes, shards)


def op5_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
