"""Fill-in-middle transformation with succinct rank and select over packed boundary bits.

The bytes of a slice of texts lie one after the other. A bitvector has a one for every byte that begins a
code point; it is packed into 64-bit words, and a directory holds the number of ones before every block of
eight words. Two ranks give the number n of code points of a text (the ones between its ends), and a select
gives the byte at which a code point begins, so texts are cut without being decoded. All texts of a slice are
ranked and selected at once.

Draws are the first four 8-digit groups of the hex sha256 of `1:` and the key: two cut points, whether the text
stays plain, and the order of its pieces:

    psm   <P> prefix <S> suffix <M> middle
    spm   <S> suffix <P> prefix <M> middle
    plain the text itself

A text that contains a sentinel stays plain, so that what is made can always be taken apart again: no sentinel
may begin as another one ends (that is checked), hence none can arise where pieces meet.

Edge cases: a null text counts as empty; an empty text stays plain, with n = 0. A null key draws as an empty one.
Repeated rows give repeated results, rows that share a key have the same draws. Texts of any length are
handled whole; a slice holds few texts if they are long. An empty table gives an empty result. `transform` keeps all other columns; those
with a name of its output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# The sentinels of prefix, suffix and middle, and the percentages of texts that change and of those whose suffix comes first.
SENTINELS = ("<P>", "<S>", "<M>")
CHANGED, SUFFIX_FIRST = 90, 20

#: Bytes of text that are indexed at once (one longer text is a slice of its own).
SLICE_BYTES = 4 << 20
WORDS = 8  # of 64 bits in a block of the directory
OUTPUT = "form string, n long, prefix_chars long, middle_chars long, output string"


class Boundaries:
    """Rank and select over the first bytes of code points."""

    def __init__(self, data: np.ndarray):
        block = 8 * WORDS
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        padded = np.zeros((len(bits) // block + 1) * block, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.n_bytes = len(data)
        self.words = padded.view("<u8").reshape(-1, WORDS)
        before = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.directory = np.concatenate([[0], np.cumsum(before)])

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """The number of ones before each place (0 to n_bytes)."""
        block, word, bit = places >> 9, (places >> 6) & 7, (places & 63).astype(np.uint64)
        words = self.words[block]
        whole = np.where(np.arange(WORDS) < word[:, None], np.bitwise_count(words), 0).sum(axis=1, dtype=np.int64)
        last = words[np.arange(len(places)), word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.directory[block] + whole + np.bitwise_count(last)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of the one that has so many ones before it; n_bytes for the total."""
        inside = np.minimum(ranks, self.total - 1)
        block = np.searchsorted(self.directory, inside, side="right") - 1
        left = inside - self.directory[block]
        sums = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        word = (sums <= left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, sums[np.arange(len(sums)), np.maximum(word, 1) - 1], 0)
        w, at = self.words[block, word], np.zeros(len(ranks), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = w & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            up = left >= ones
            left, at = np.where(up, left - ones, left), at + width * up
            w = np.where(up, w >> np.uint64(width), low)
        return np.where(ranks < self.total, (block << 9) + (word << 6) + at, self.n_bytes)


@dataclass(frozen=True)
class Plan:
    sentinels: tuple[str, str, str] = SENTINELS
    changed: int = CHANGED
    suffix_first: int = SUFFIX_FIRST

    def __post_init__(self):
        for i, a in enumerate(self.sentinels):
            overlaps = any(b.startswith(a[-k:]) for b in self.sentinels for k in range(1, len(a)))
            inside = any(a in b for j, b in enumerate(self.sentinels) if i != j)
            if not a or overlaps or inside:
                raise ValueError(f"sentinels must not be empty, overlap or contain each other: {self.sentinels}")


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have at most SLICE_BYTES together, or one row."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield at, to
        at = to


def rearranged(texts: pa.Array, draws: np.ndarray, plan: Plan) -> list[pa.Array]:
    """The output columns for texts (large_binary, no nulls) and draws (a row of four for each)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
    bits, ends = Boundaries(raw), offsets - offsets[0]
    ranks = bits.rank(ends)
    n = np.diff(ranks)
    cuts = np.sort(draws[:, :2] % (n[:, None] + 1), axis=1)
    first, second = (bits.select(ranks[:-1] + cuts[:, k]) for k in range(2))
    plain = (n == 0) | (draws[:, 2] % 100 >= plan.changed)
    for s in plan.sentinels:
        plain |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    spm = draws[:, 3] % 100 < plan.suffix_first
    view, (p, s, m) = memoryview(raw), (x.encode() for x in plan.sentinels)
    made = []
    for i in range(len(n)):
        a, b, c, d = ends[i], first[i], second[i], ends[i + 1]
        if plain[i]:
            made.append(bytes(view[a:d]))
        elif spm[i]:
            made.append(b"".join((s, view[c:d], p, view[a:b], m, view[b:c])))
        else:
            made.append(b"".join((p, view[a:b], s, view[c:d], m, view[b:c])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    chars = [pa.array(x, pa.int64(), mask=plain) for x in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
    return [pa.array(form.tolist(), pa.string()), pa.array(n, pa.int64()), *chars, pa.array(made, pa.binary()).cast(pa.string())]


def draws(key: Column) -> Column:
    """Four numbers below 2^32 from the sha256 of `1:` and the key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(1), F.lit(25), F.lit(8)), lambda at: F.conv(F.substr(digest, at, F.lit(8)), 16, 10).cast("long"))


def transform(docs: DataFrame, key: str = "doc_id", plan: Plan = Plan()) -> DataFrame:
    """docs with form, n (code points), prefix_chars and middle_chars (null if plain) and output."""
    small_batches(docs.sparkSession)
    names = [f.split(" ")[0] for f in OUTPUT.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("text", F.lit("")).alias("_text"), draws(F.col(key)).alias("_draws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.large_binary())
            drawn = batch.column(len(kept) + 1).flatten().to_numpy().reshape(-1, 4)
            for a, b in _slices(pc.binary_length(texts).to_numpy()):
                more = rearranged(texts.slice(a, b - a), drawn[a:b], plan)
                own = batch.slice(a, b - a).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*own, *more], [*kept, *names])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    for field in OUTPUT.split(", "):
        schema = schema.add(*field.split(" "))
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that `transform` made an output of."""
    pieces = F.split(output, "|".join("\\Q" + s + "\\E" for s in plan.sentinels), -1)
    at = lambda *order: F.concat(*[F.get(pieces, F.lit(k)) for k in order])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def _group_sql(k: int) -> str:
    return f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT doc_id, t, length(t)::BIGINT AS n, {", ".join(_group_sql(k) for k in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {CHANGED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
