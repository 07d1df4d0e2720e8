"""Exact top-k search by a three-phase uniform threshold.

The dimensions of the integer vectors are split into lists (here 2). In each list a vector has a
local score for a query: the inner product over the list's dimensions. The total is the sum.

Candidates (by the length of their vectors) and queries are packed into blocks of bounded size. Blocks meet in a grid of
tasks: a candidate block goes to one row of the grid and a query block to one column, and the numbers of rows and columns
are chosen so that little is sent twice; nothing is broadcast.

1. Gather: a bounded number of candidate blocks takes the best `gathered` local scores of every list and adds up the
   totals of these. The k-th best total of a query is its cutoff: since so many candidates reach it, no vector
   below it can be among the best k.
2. The cutoffs go to the query blocks. A vector whose total reaches the cutoff has one list with at least
   1/lists of it: that is the uniform threshold. By the lengths of the parts of vectors (Cauchy and Schwarz), queries and
   candidates that reach it in no list leave before any score is computed; of the others, the entries that
   reach it are collected.
3. Resolve: only the collected entries get their scores in the other lists added, and those below the cutoff go.

Each meeting returns at most the k best of its block, by (score, smaller id), which cannot
lose one of the overall best k; a window picks these. Ties go to the smaller id.

What the threshold saves depends on the data: vectors of one length in random directions leave early in no list,
so their local scores are all computed once, and some 2 % of them are collected and resolved.

Edge cases: vectors that are null or have null, NaN or infinite components take no part, nor do rows without an id, nor vectors
whose integers have a squared length of 2^63 or more: of the others no score passes 64 bits. Shorter
vectors count as filled up with zeros; a block holds fewer vectors if they are long. Empty vectors score 0. Repeated ids are separate
candidates, none of which a query with that id may find; each row of a repeated query id is a query of its own, with its own
ranks. With fewer candidates than k, all are returned. An empty table gives an empty result. Further columns are
ignored. Scores are exact: where sums could pass 53 bits, 64-bit integers are used, and where their bounds could pass 63 bits Python's.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, table

K, LISTS, GATHERED = 5, 2, 32
#: Rows of a block of candidates and of queries; queries that are scored at once; candidate blocks of the first phase.
BLOCK, QUERY_BLOCK, AT_ONCE, GATHER_BLOCKS = 8192, 4096, 256, 16
#: Integers of a block at most, unless one vector has more.
CELLS = 1 << 22
#: Tasks of the grid at most: what is shuffled grows with the root of it. Each has a part of the meetings, whatever the session's shuffle partitions are.
TASKS = 128


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component, for the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # A little below 2^63, for the rounding of the sum.
    fine &= F.aggregate(e, F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2.0)) < float(2**63 - 2**20)
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """key (of the task and the block in it), ids and rows as binaries of integers, n and dim; at most `size` rows a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[list[int]] = []
        task, made, widest = TaskContext.get().partitionId(), 0, 0

        def block() -> pa.RecordBatch:
            dim = max(map(len, vectors))
            m = np.zeros((len(ids), dim), dtype=np.int64)
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            small = m.size == 0 or (m.min() >= -(2**15) and m.max() < 2**15)
            a, data = np.array(ids, dtype=np.int64).tobytes(), m.astype(np.int16 if small else np.int64).tobytes()
            columns = ([(task << 32) + made], [a], [data], [len(ids)], [dim])
            ids.clear(), vectors.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["key", "ids", "m", "n", "dim"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (len(ids) == size or (len(ids) + 1) * max(widest, len(v)) > CELLS):
                    yield block()
                    made, widest = made + 1, 0
                ids.append(i), vectors.append(v)
                widest = max(widest, len(v))
        if ids:
            yield block()

    return rows.mapInArrow(run, "key long, ids binary, m binary, n int, dim int")


def _matrix(data: bytes, n: int, dim: int, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int16 if len(data) == 2 * n * dim else np.int64).reshape(n, dim)[:, :width].astype(np.int64)


def exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the fastest type in which no inner product, nor a part of one, is rounded."""
    largest = lambda m: max(-int(m.min()), int(m.max())) if m.size else 0
    bound = largest(q) * largest(c) * max(1, q.shape[1])
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    return q.astype(kind), c.astype(kind)


def _parts(width: int, lists: int) -> list[slice]:
    edges = [width * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _meeting(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, query vectors and candidate vectors, as wide as the narrower block: what is beyond meets zeros."""
    width = min(row["dim"], row["q_dim"])
    q, c = exact(_matrix(row["q_m"], row["q_n"], row["q_dim"], width), _matrix(row["m"], row["n"], row["dim"], width))
    return np.frombuffer(row["q_ids"], dtype=np.int64), np.frombuffer(row["ids"], dtype=np.int64), q, c


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row: a row has two blocks, so a batch of them is not made into Python objects at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _gather(k: int, lists: int, gathered: int):
    """q_key and totals: the k best totals of every query of the block, query by query, or fewer (then nulls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            qids, ids, q, c = _meeting(row)
            take, out = min(gathered, len(ids)), []
            for at in range(0, len(qids), AT_ONCE):
                scores = [q[at : at + AT_ONCE, s] @ c[:, s].T for s in _parts(q.shape[1], lists)]
                tops = [np.argpartition(-s, take - 1, axis=1)[:, :take] for s in scores]
                for i, own in enumerate(qids[at : at + AT_ONCE]):
                    found = np.unique(np.concatenate([t[i] for t in tops]))
                    found = found[ids[found] != own]
                    best = sorted((int(x) for x in sum(s[i, found] for s in scores)), reverse=True)[:k]
                    out.append(best)
            yield pa.RecordBatch.from_arrays([pa.array([row["q_key"]], pa.int64()), pa.array([out], pa.list_(pa.list_(pa.int64())))], ["q_key", "totals"])

    return run


def cutoffs(totals: list[list[list[int]]], k: int) -> list[int | None]:
    """For each query the k-th best of the totals of all gathered blocks; null if there are fewer."""
    out = []
    for of_query in zip(*totals, strict=True):
        best = sorted((x for block in of_query for x in block), reverse=True)
        out.append(best[k - 1] if len(best) >= k else None)
    return out


def _lengths(m: np.ndarray, parts: list[slice]) -> np.ndarray:
    """Length of each row's part in every list, a little rounded up."""
    return np.stack([np.sqrt((m[:, s].astype(np.float64) ** 2).sum(axis=1)) for s in parts]) * (1 + 1e-9)


def collect(q: np.ndarray, c: np.ndarray, cuts: list[int | None], lists: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each query: its row, how many scores were computed for it, the candidates (rows) that reach its cutoff, and their totals."""
    parts = _parts(q.shape[1], lists)
    q_length, c_length = _lengths(q, parts), _lengths(c, parts)
    least = np.array([-np.inf if x is None else x for x in cuts], dtype=np.float64)
    least -= 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))
    bar = np.where(least > 0, least / lists, -np.inf)  # a negative cutoff bounds nothing by lengths
    stays = (q_length * c_length.max(axis=1, initial=0)[:, None] >= bar).any(axis=0)
    for at in range(0, len(q), AT_ONCE):
        rows = np.flatnonzero(stays[at : at + AT_ONCE]) + at
        if not len(rows):
            continue
        near = np.flatnonzero((c_length * q_length[:, rows].max(axis=1)[:, None] >= bar[rows].min()).any(axis=0))
        scores = [q[rows, s] @ c[near, s].T for s in parts]
        for i, r in enumerate(rows):
            cut = cuts[r]
            if cut is None:  # fewer than k candidates were gathered: every one is wanted
                found = np.arange(len(near))
            else:
                reach = lists * scores[0][i] >= cut  # the uniform threshold
                for s in scores[1:]:
                    reach |= lists * s[i] >= cut
                found = np.flatnonzero(reach)
            totals = sum(s[i, found] for s in scores)
            if cut is not None:
                found, totals = found[totals >= cut], totals[totals >= cut]
            yield int(r), len(near), near[found], totals


def _resolve(k: int, lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            qids, ids, q, c = _meeting(row)
            out: tuple[list, ...] = ([], [], [], [])
            for r, _, found, totals in collect(q, c, cutoffs(row["totals"], k) if row["totals"] else [None] * len(qids), lists):
                other = ids[found] != qids[r]
                best = sorted(zip((-totals[other]).tolist(), ids[found[other]].tolist(), strict=True))[:k] if other.any() else []
                out[0].extend([r] * len(best)), out[1].extend([int(qids[r])] * len(best))
                out[2].extend(i for _, i in best), out[3].extend(int(-t) for t, _ in best)
            keys = pa.array([row["q_key"]] * len(out[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, pa.int64()) for x in out]], ["q_key", "q_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS, gathered: int = GATHERED) -> DataFrame:
    """query_id, rank, vec_id and score: vectors and queries have vec_id (long) and v (array of long)."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    by_length = vectors.select("vec_id", "v", length.alias("length"), F.xxhash64("vec_id", "v").alias("h")).repartitionByRange("length", "h").sortWithinPartitions("length", "h")
    blocks = settle(_pack(by_length.select("vec_id", "v"), BLOCK), "blocks")
    asked = settle(_pack(queries.select("vec_id", "v"), QUERY_BLOCK).select(*[F.col(c).alias(f"q_{c}") for c in ("key", "ids", "m", "n", "dim")]), "queries")
    n_blocks, n_asked = max(1, blocks.count()), max(1, asked.count())
    # Every candidate block goes to all columns of the grid, every query block to all rows of it.
    tasks = min(TASKS, n_blocks * n_asked)
    columns = min(n_asked, max(1, round(sqrt(tasks * n_asked / n_blocks))))
    rows = min(n_blocks, ceil(tasks / columns))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def meet(some: DataFrame, asked: DataFrame) -> DataFrame:
        # A hint, since a planner that sees the size of the files, not of what is exploded from them, would broadcast it.
        left = some.withColumn("cp", part("key", rows)).withColumn("qp", each(columns)).repartition(rows * columns, "cp", "qp").hint("merge")
        return left.join(asked.withColumn("qp", part("q_key", columns)).withColumn("cp", each(rows)).repartition(rows * columns, "cp", "qp"), ["cp", "qp"])

    chosen = blocks.select("key").orderBy(F.xxhash64("key"), "key").limit(GATHER_BLOCKS)  # any blocks give a safe cutoff
    first = blocks.join(F.broadcast(chosen), "key") if n_blocks > GATHER_BLOCKS else blocks
    gathered_ = settle(meet(first, asked).mapInArrow(_gather(k, lists, gathered), "q_key long, totals array<array<long>>"), "gathered")
    totals = gathered_.groupBy("q_key").agg(F.collect_list("totals").alias("totals"))  # of at most GATHER_BLOCKS blocks
    told = settle(asked.hint("merge").join(totals, "q_key", "left"), "told")
    found = meet(blocks, told).mapInArrow(_resolve(k, lists), "q_key long, q_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_key", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
