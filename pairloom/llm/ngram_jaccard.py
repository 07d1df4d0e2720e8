"""N-gram Jaccard join: prefix-tree join of the 5-word shingle sets of documents.

Two documents link when the Jaccard similarity of their sets is 0.8 or more, exactly (shingles are
64-bit hashes). The result is each document's component.

1. Equal sets are one class from here on (grouped by a 128-bit digest, partly before the shuffle).
   Classes are named by their smallest doc_id.
2. Shingles get a global order: by hash, but frequent ones last. Frequent are those that repeat
   within an input batch and do so `heavy` times over all batches. At most a 2^20-th of all shingles can be
   that frequent in a large corpus, so their list (8 MB at most) is sent to the tasks. Any order gives the same
   links; this one keeps passages that many documents share from making large groups.
3. Linked sets share a shingle among their first n - ceil(0.8 n) + 1. These are dealt to buckets by
   hash; a bucket's task sorts them and returns those of two sets or more.
4. Round one pairs each set of such a group with the group's smallest id only, and in groups of frequent
   shingles also with the set that is in most of these groups. Pairs are checked by
   size and by parity sketches (the sketches' difference is never more than the sets'). The
   sets of those left are joined to their centre, in parts of bounded size, as a prefix tree: partners
   in global order, one walk that shares the overlaps of common beginnings, and leaves a subtree
   when the shingles that remain cannot bring the overlap that is needed.
5. Round two takes the groups of three sets or more whose members are in different components after
   round one, and makes all pairs between components that sizes allow: of small groups directly, of
   groups over `HOT` sets in blocks, where a pair counts only with the first frequent group that it shares,
   and has to pass the sketches at once. Large groups are cut into blocks that meet in separate
   tasks. So no link between components is lost, and copies of one text never make pairs.

Edge cases: null, empty and blank texts have no shingles and link with nothing. A text of one to four
words has one shingle, all its words. Rows that share a doc_id are one document: its links are those of all its
texts, so they are in one component (for the join each text of such an id gets an id of its own). doc_id is a whole number; rows
without one link with nothing, have no component, and stay in `keep_one`, which else keeps one row of each component. An empty
table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_ids, settle, table
from .components import components

N_WORDS, NUM, DEN = 5, 4, 5  # shingle length; the similarity 4/5
HEAVY = 64
#: Sets of a group that is worked in blocks, rows of a block, partners of a part in the check, entries of a bucket.
HOT, BLOCK, PARTNERS, BUCKET = 64, 2048, 256, 500_000
#: Documents that a task holds at once while it makes shingles.
SLICE = 2048
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_hash = xxhash.xxh3_64_intdigest


def shingles(text: str | None, n_words: int = N_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII gaps split
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_hash, words), dtype=np.uint64, count=len(words))
    k = min(n_words, len(words))
    m = len(words) - k + 1
    h = np.full(m, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(31))) * MULTIPLIER + w[j : m + j]
    h ^= h >> np.uint64(29)
    h *= MULTIPLIER
    h ^= h >> np.uint64(32)
    return np.unique(h)


def prefix_length(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1


def needed(n: int, m: int) -> int:
    """Least overlap of sets of n and m with intersection / union >= 4/5."""
    return (NUM * (n + m) + NUM + DEN - 1) // (NUM + DEN)


def sketch(tokens: np.ndarray) -> bytes:
    """Parity bits: bit i tells whether an odd number of tokens falls on i. Two to four bits a token."""
    width = 64
    while width < 2 * len(tokens) and width < 1 << 17:
        width *= 2
    return np.packbits((np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) at the width of `size` bytes: the sketch of the same sets at that width."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(a: list[bytes], n: np.ndarray, b: list[bytes], m: np.ndarray) -> np.ndarray:
    """For each pair (a[i], b[i]): whether sizes and sketches allow a similarity of 4/5."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    ok = DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)
    widths_a, widths_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    most = n + m - 2 * ((NUM * (n + m) + NUM + DEN - 1) // (NUM + DEN))
    for wa, wb in {(int(x), int(y)) for x, y in zip(widths_a[ok], widths_b[ok], strict=True)}:
        at = np.flatnonzero(ok & (widths_a == wa) & (widths_b == wb))
        for part in np.array_split(at, len(at) // 20_000 + 1):
            x = _folded(np.frombuffer(b"".join([a[i] for i in part]), dtype=np.uint8).reshape(-1, wa), min(wa, wb))
            y = _folded(np.frombuffer(b"".join([b[i] for i in part]), dtype=np.uint8).reshape(-1, wb), min(wa, wb))
            ok[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[part]
    return ok


def trie_links(probe: np.ndarray, partners: list[np.ndarray]) -> list[bool]:
    """Which partners link with the probe: one walk over the prefix tree of the partners."""
    own, n = set(probe.tolist()), len(probe)
    order = sorted(range(len(partners)), key=lambda i: partners[i].astype(">u8").tobytes())
    out = [False] * len(partners)
    overlap, path = [0], np.zeros(0, dtype=np.uint64)  # overlap[d]: of the first d tokens on the path
    for i in order:
        y = partners[i]
        m = len(y)
        common = min(m, len(path), len(overlap) - 1)
        differ = np.flatnonzero(y[:common] != path[:common])
        depth = int(differ[0]) if len(differ) else common
        del overlap[depth + 1 :]
        least, o, path = needed(n, m), overlap[depth], y
        for token in y[depth:].tolist():
            if o + m - depth < least:  # what remains below here is too little
                break
            o += token in own
            depth += 1
            overlap.append(o)
        out[i] = depth == m and o >= least
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass: documents (doc_id, n, s1, s2, sketch) and locally repeated shingles (token, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, rows, new, seen = batch.column(0).to_pylist(), [], [], set()
            for text in batch.column(1):
                t = shingles(text.as_py())
                d = xxhash.xxh3_128_digest(t.tobytes())
                rows.append((len(t), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), sketch(t) if len(t) else None))
                if d not in seen:
                    seen.add(d)
                    new.append(t)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "n", "s1", "s2", "sketch", "token", "times"]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())], names)
            tokens, times = np.unique(np.concatenate(new), return_counts=True) if new else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            tokens, times = tokens[times > 1], times[times > 1]
            k = len(tokens)
            empty = [pa.nulls(k, t) for t in (pa.int64(), *kinds)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(tokens.view(np.int64)), pa.array(times.astype(np.int64))], names)

    both = settle(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n int, s1 long, s2 long, sketch binary, token long, times long"), "sets"
    )
    return both.where("token IS NULL").drop("token", "times"), both.where("token IS NOT NULL").select("token", "times")


def _buckets(docs: DataFrame, heavy: np.ndarray, n_buckets: int) -> DataFrame:
    """token, doc_id, n, center, center_n of the prefix shingles that two sets or more have.

    Of frequent ones all, whose rows never meet here; they have no center.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    names = ["bucket", "token", "doc", "n"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in _slices(batches):
            tokens, docs_of, sizes, frequent = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = shingles(text.as_py())
                n = len(t)
                if not n or i is None:
                    continue
                p = prefix_length(n)
                at = np.minimum(np.searchsorted(often, t), max(0, len(often) - 1))
                is_often = often[at] == t if len(often) else np.zeros(n, dtype=bool)
                rare = t[~is_often][:p]
                rest = t[is_often][: p - len(rare)]
                tokens += [rare, rest]
                frequent.append(np.r_[np.zeros(len(rare), dtype=bool), np.ones(len(rest), dtype=bool)])
                docs_of.append(np.full(p, i, dtype=np.int64))
                sizes.append(np.full(p, n, dtype=np.int32))
            if not tokens:
                continue
            t, d, n, f = (np.concatenate(x) for x in (tokens, docs_of, sizes, frequent))
            bucket = (t % np.uint64(n_buckets)).astype(np.int64)
            bucket[f] = -1 - (d[f] % n_buckets)  # these need not meet, and so are spread
            order = np.argsort(bucket, kind="stable")
            t, d, n, bucket = t[order], d[order], n[order], bucket[order]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[edges[1:], len(bucket)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[edges]), *[pa.array([x[a:b].tobytes() for a, b in zip(edges, ends, strict=True)], pa.binary()) for x in (t, d, n)]], names
            )

    def rows(t: np.ndarray, d: np.ndarray, n: np.ndarray, frequent: bool) -> pa.RecordBatch:
        order = np.lexsort((d, t))
        t, d, n = t[order], d[order], n[order]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, dtype=np.int64)
        length = np.diff(np.r_[starts, len(t)])
        keep = np.repeat(length, length) >= (1 if frequent else 2)
        own = [pa.array(x[keep]) for x in (t.view(np.int64), d, n)]
        center = [pa.nulls(len(own[0]), k) if frequent else pa.array(np.repeat(x[starts], length)[keep]) for x, k in ((d, pa.int64()), (n, pa.int32()))]
        return pa.RecordBatch.from_arrays([*own, *center], ["token", "doc_id", "n", "center", "center_n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        join = lambda: [np.frombuffer(b"".join([h[i] for h in held]), dtype=k) for i, k in enumerate((np.uint64, np.int64, np.int32))]
        for batch in batches:
            for bucket, *blobs in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if held and (bucket != now or bucket < 0):
                    yield rows(*join(), now < 0)
                    held = []
                now = bucket
                held.append(blobs)
        if held:
            yield rows(*join(), now < 0)

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "bucket long, token binary, doc binary, n binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "token long, doc_id long, n int, center long, center_n int")


def _stars(groups: DataFrame) -> DataFrame:
    """The pairs (center, doc_id) of round one, those that sizes allow."""
    fits = lambda n, m: DEN * F.least(n, m) >= NUM * F.greatest(n, m)
    rare = groups.where("doc_id <> center").where(fits("n", "center_n")).select("center", "doc_id")
    often = groups.where("center IS NULL").select("token", "doc_id", "n")
    held = often.groupBy("doc_id").agg(F.count(F.lit(1)).alias("held"))
    rank = F.struct("held", (-F.col("doc_id")).alias("last"))  # of equals the smallest id
    sides = often.join(held, "doc_id").groupBy("token").agg(F.min("doc_id").alias("lo"), F.max(rank).alias("top"))
    centers = settle(sides.select("token", F.explode(F.array_distinct(F.array("lo", -F.col("top.last")))).alias("center")), "centers")
    return rare.unionByName(often.join(centers, "token").where("doc_id <> center").select("center", "doc_id")).distinct()


def _sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (center, doc_id) that sizes and sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n, b, m = (batch.column(i) for i in range(2, 6))
            ok = may_link(a.to_pylist(), n.to_numpy(), b.to_pylist(), m.to_numpy())
            yield batch.select([0, 1]).filter(pa.array(ok))

    wanted = settle(pairs.select("doc_id").union(pairs.select("center")).distinct(), "wanted")
    s = settle(by_ids(sketches.select("doc_id", "sketch", "n"), wanted, "left_semi"), "wanted-sketches")
    both = pairs.join(s, "doc_id").join(s.select(F.col("doc_id").alias("center"), F.col("sketch").alias("c_sketch"), F.col("n").alias("c_n")), "center")
    return both.select("center", "doc_id", "sketch", "n", "c_sketch", "c_n").mapInArrow(run, "center long, doc_id long").distinct()


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (center, doc_id) whose sets link, by the prefix trees of the centres' partners."""
    wanted = settle(pairs.select("doc_id").union(pairs.select("center")).distinct(), "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x.as_py()).tobytes() for x in part.column(1)], pa.binary())], ["doc_id", "tokens"])

    texts = by_ids(docs.select(F.col("doc_id").cast("long"), "text"), wanted, "left_semi")
    sets = settle(texts.mapInArrow(read, "doc_id long, tokens binary").dropDuplicates(["doc_id"]), "wanted-sets")
    parts = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    parts = settle(parts, "parts")
    members = pairs.join(parts, "center").select("center", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id", F.lit(False).alias("probe"))
    probes = parts.select("center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("center").alias("doc_id"), F.lit(True).alias("probe"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            links = trie_links(probe, [p for _, p in partners]) if partners else []
            found = [i for (i, _), ok in zip(partners, links, strict=True) if ok]
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

        now, probe, partners = None, None, []
        for batch in batches:
            for center, part, doc, is_probe, tokens in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if now != (center, part):
                    if now is not None:
                        yield done()
                    now, partners = (center, part), []
                t = np.frombuffer(tokens, dtype=np.uint64)
                if is_probe:
                    probe = t
                else:
                    partners.append((doc, t))
        if now is not None:
            yield done()

    rows = members.unionByName(probes).join(sets, "doc_id").select("center", "part", "doc_id", "probe", "tokens")
    return rows.repartition("center", "part").sortWithinPartitions("center", "part", F.desc("probe")).mapInArrow(walk, "a long, b long")


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first `n_keys` columns, without these."""
    now, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now != row[:n_keys]:
                if held:
                    yield now, held
                now, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield now, held


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["center", "doc_id"])


def _small_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, doc_id, n, component, sorted by token: pairs between components that sizes allow."""
    found: list[np.ndarray] = []
    size = 0

    def drained() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found or [np.zeros((0, 2), dtype=np.int64)]), axis=0)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["center", "doc_id"])

    for _, rows in _grouped(batches, 1):
        doc, n, comp = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
        i, j = np.triu_indices(len(rows), 1)
        ok = (comp[i] != comp[j]) & (doc[i] != doc[j]) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        if len(i):
            found.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], axis=1))
            size += len(i)
        if size >= 300_000:
            yield drained()
            size = 0
    yield drained()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, i, j, own, doc_id, n, component, sketch, tokens, sorted by the first three: two blocks of a large group.

    A pair counts if the token is the first that both documents' `tokens` have.
    """
    for (token, i, j), rows in _grouped(batches, 3):
        own, doc, n, comp = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
        places: dict[int, int] = {}
        cells = [(r, places.setdefault(t, len(places))) for r, row in enumerate(rows) for t in row[5] if t < token]
        earlier = np.zeros((len(rows), max(1, len(places))), dtype=np.float32)
        if cells:
            earlier[tuple(np.array(cells).T)] = 1
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found: list[tuple[int, int]] = []
        for part in np.array_split(left, len(left) // 256 + 1):
            shared = earlier[part] @ earlier[right].T > 0
            for x, met in zip(part.tolist(), shared, strict=True):
                y = right[~met & (comp[right] != comp[x]) & (doc[right] != doc[x])]
                y = y[y > x] if i == j else y
                y = y[DEN * np.minimum(n[y], n[x]) >= NUM * np.maximum(n[y], n[x])]
                if len(y):
                    ok = may_link([rows[x][4]] * len(y), np.full(len(y), n[x]), [rows[k][4] for k in y.tolist()], n[y])
                    found += [(min(int(doc[x]), d), max(int(doc[x]), d)) for d in doc[y[ok]].tolist()]
        yield _pair_batch(found)


def _between_components(groups: DataFrame, labels: DataFrame, sketches: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs (center, doc_id) that share a group but no component, and that sizes and sketches allow; without those tested."""
    g = groups.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    g = g.select("token", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    sizes = g.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    sizes = settle(sizes.where("lo < hi AND size > 2").select("token", "size"), "open")  # two sets alone have met in round one
    rows = settle(g.join(sizes, "token"), "open-rows")
    small = rows.where(F.col("size") <= HOT).select("token", "doc_id", "n", "component").repartition("token").sortWithinPartitions("token")
    pairs = small.mapInArrow(_small_groups, "center long, doc_id long").distinct().join(tested, ["center", "doc_id"], "left_anti")
    near = _sketched(settle(pairs, "small-pairs"), sketches)

    large = rows.where(F.col("size") > HOT)
    lists = large.groupBy("doc_id").agg(F.collect_set("token").alias("tokens"))  # no longer than a document's prefix
    d = large.join(lists.join(sketches.select("doc_id", "sketch"), "doc_id"), "doc_id")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    d = d.withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    d = d.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "n", "component", "sketch", "tokens")
    met = d.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_blocks, "center long, doc_id long")
    return near.unionByName(met.join(tested, ["center", "doc_id"], "left_anti")).distinct()


def _components(docs: DataFrame, rows: DataFrame, repeated: DataFrame, heavy: int, same: DataFrame | None = None) -> DataFrame:
    """doc_id, n, component of every row of a table in which a doc_id has one text; `same` are more links (a, b)."""
    classes = settle(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id")), "classes")
    members = settle(rows.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").select("doc_id", "n", "class_id"), "members")
    total = rows.agg(F.sum("n")).first()[0] or 0
    often = max(heavy, total >> 20)  # so at most 2^20 tokens are frequent
    found = repeated.groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= often).select("token").collect()
    frequent = np.sort(np.array([r[0] for r in found], dtype=np.int64).view(np.uint64))
    n_buckets = 256
    while n_buckets * BUCKET < total // 4:
        n_buckets *= 2
    copies = settle(members.where("class_id IS NULL OR doc_id <> class_id").select("doc_id").distinct(), "copies")
    first = by_ids(docs.select(F.col("doc_id").cast("long"), "text"), copies, "left_anti")
    groups = settle(_buckets(first, frequent, n_buckets), "groups")
    sketches = by_ids(rows.where("n > 0").select("doc_id", "n", "sketch"), copies, "left_anti")
    stars = settle(_stars(groups), "stars")
    links = settle(_linked(settle(_sketched(stars, sketches), "pairs"), docs), "links")
    between = settle(_between_components(groups, components(links), sketches, stars), "pairs")
    every = links.unionByName(settle(_linked(between, docs), "links"))
    if same is not None:
        of = members.where("class_id IS NOT NULL").select("doc_id", "class_id").distinct()
        ends = same.join(of.withColumnsRenamed({"doc_id": "a", "class_id": "ca"}), "a").join(of.withColumnsRenamed({"doc_id": "b", "class_id": "cb"}), "b")
        every = every.unionByName(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    labels = settle(components(every), "components")
    out = members.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows, repeated = _sets(docs)
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("n", "s1", "s2").alias("k")).where("k > 1").select("doc_id")
    several = settle(several, "several")
    if not several.limit(1).count():
        return _components(docs, rows, repeated, heavy)
    # Ids with several texts: each of these texts gets an id of its own and a link to the others.
    whose = docs.join(several.withColumn("known", F.lit(True)), "doc_id", "left").select(
        F.col("doc_id").alias("own"), F.when(F.col("known"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("doc_id"), "text"
    )
    whose = settle(whose, "several-texts")
    alone = whose.select("doc_id", "text")
    of = settle(whose.where("own <> doc_id").select("own", "doc_id").distinct(), "several-ids")
    same = of.join(of.groupBy("own").agg(F.min("doc_id").alias("a")), "own").select("a", F.col("doc_id").alias("b"))
    rows, repeated = _sets(alone)
    out = settle(_components(alone, rows, repeated, heavy, same).join(of, "doc_id", "left"), "several-components")
    out = out.select(F.coalesce("own", "doc_id").alias("doc_id"), "n_shingles", "component_id")
    # A document without words may be one with words elsewhere: what its texts have in common is the id.
    least = out.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    out = out.join(settle(least, "several-least"), "component_id", "left")
    best = settle(out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("least").alias("best")), "several-best")
    return out.join(best, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("best", "least").alias("component_id"))


def keep_one(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component, one for each, with all columns."""
    found = jaccard_components(docs, heavy)
    kind = docs.schema["doc_id"].dataType
    others = found.where("doc_id <> component_id").select(F.col("doc_id").cast(kind)).distinct()
    kept = by_ids(docs, settle(others, "others"), "left_anti").select(*docs.columns)
    again = settle(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").cast(kind)), "again")
    if not again.limit(1).count():
        return kept
    one = by_ids(kept, again, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")).select("row.*")
    return by_ids(kept, again, "left_anti").select(*docs.columns).unionByName(one)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
