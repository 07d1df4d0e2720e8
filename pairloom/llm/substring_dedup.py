"""Substring dedup by hashing lines, cut at the ends of sentences.

Passages that documents share often start inside a line, so the units are the pieces of a line up to
`.`, `!` or `?` and a gap (or a full stop of an unspaced script). Every unit is normalised (lower case,
one space for each gap) and hashed to 128 bits. Digests are grouped over all documents: counts and the
earliest occurrence are summed before the shuffle. The occurrence with the smallest doc_id, and there the
first, is kept, and all others are repeated.

Repeated units that follow each other make a run, which is removed as one span with its offsets in the
original text. A span ends where an unrepeated unit begins, so text that occurs once is never removed.
`min_words` is the number of words that a run must have: 1, the default, removes every repeated unit.

Offsets are code points of the original text, end exclusive. In scripts without spaces each character
counts as a word.

Edge cases: a null or empty text has no units. Rows with the same doc_id and the same text are one
document (all of them get its spans in `remove`); rows with the same doc_id but another text are separate
documents that follow each other by the texts' hashes. Null doc_ids come last. Exact copies lose all
but the first. An empty table gives an empty result. Columns other than doc_id and text are ignored
(and kept by `remove`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, table

#: Words of a run that the query removes: half of a passage of 50 words. README tells what it leaves in place.
RUN_WORDS = 25
BOUNDARY = re.compile(r"[.!?][\x20\x09]+|[。！？]|\n")
#: Scripts without spaces between words (Thai, Lao, Burmese, Khmer, Japanese, Chinese): each character counts as a word.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")


def units_of(text: str) -> list[tuple[int, int, int, bytes]]:
    """start, end, words and normalised bytes of the units of a text: pieces with a word."""
    unspaced = not text.isascii() and UNSPACED.search(text) is not None
    out, at = [], 0
    for m in [*BOUNDARY.finditer(text), None]:
        end = len(text) if m is None else m.start() + (m[0][0] != "\n")
        piece = text[at:end].lower()
        words = piece.encode().split()
        if words:
            n = len(UNSPACED.sub(r" \g<0> ", piece).encode().split()) if unspaced else len(words)
            out.append((at, end, n, b" ".join(words)))
        if m:
            at = m.end()
    return out


def _digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def units(docs: DataFrame, places: bool = True) -> DataFrame:
    """A row for each unit: doc_id, t (hash of the text), d1, d2 and, with `places`, unit (its number), again, start, end, words.

    again is true behind the first occurrence in a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                index, rows = [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    seen: set[tuple[int, int]] = set()
                    for unit, (start, end, words, data) in enumerate(units_of(text or "")):
                        d = _digest(data)
                        rows.append((*d, unit, d in seen, start, end, words))
                        index.append(i)
                        seen.add(d)
                own = pa.array(np.array(index, dtype=np.int32))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                n = len(kinds) if places else 2
                names = ["doc_id", "t", "d1", "d2", "unit", "again", "start", "end", "words"]
                ids = [part.column(0).take(own), part.column(1).take(own)]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c, t) for c, t in zip(columns[:n], kinds[:n], strict=True)]], names[: n + 2])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", unit int, again boolean, start int, end int, words int" if places else ""
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {kind}, t long, d1 long, d2 long{more}")


def repeated_passages(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """A row for each passage to remove: doc_id, t, start, end, n_units, n_words, first_doc_id (where its first unit stays)."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    groups = units(docs, False).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
    repeated = settle(groups.where("n > 1").drop("n"), "repeated")
    found = units(docs).join(repeated, ["d1", "d2"])
    later = found.where((rank != F.col("first")) | F.col("again"))
    # Rows that are repeated as a whole are one document: merged before the shuffle.
    one = later.groupBy("doc_id", "t", "unit").agg(*[F.first(c).alias(c) for c in ("start", "end", "words")], F.first("first.doc_id").alias("first_doc_id"))
    in_doc = Window.partitionBy("doc_id", "t").orderBy("unit")
    return (
        one.withColumn("run", F.col("unit") - F.row_number().over(in_doc))
        .groupBy("doc_id", "t", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count(F.lit(1)).alias("n_units"),
            F.sum("words").alias("n_words"),
            F.min_by("first_doc_id", "unit").alias("first_doc_id"),
        )
        .where(F.col("n_words") >= min_words)
        .drop("run")
    )


def remove(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """The rows and columns of docs, text without its repeated passages, and removed_spans: their original (start, end)."""
    found = repeated_passages(docs, min_words).groupBy("doc_id", "t")
    spans = found.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")).select(F.struct("doc_id", "t").alias("of"), "spans")
    d = docs.select(F.struct(*docs.columns).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("t")).alias("of")).join(spans, "of", "left")
    text = F.col("row.text")
    kept = F.zip_with(
        F.concat(F.array(F.lit(0)), F.col("spans.end")),
        F.concat(F.col("spans.start"), F.array(F.length(text))),
        lambda a, b: F.substring(text, a + 1, b - a),
    )
    new = F.when(F.col("spans").isNotNull(), F.array_join(kept, "")).otherwise(text).alias("text")
    columns = [new if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "removed_spans"]
    return d.select(*columns, F.col("spans").alias("removed_spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), RUN_WORDS).drop("t")


SQL = rf"""
WITH p AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?s)[^\n]*?(?:[.!?][\x20\x09]+|[。！？]|\n|\z)') AS ps FROM documents WHERE text IS NOT NULL
),
e AS (
  SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS start
  FROM (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p)
),
u AS (
  SELECT doc_id, start, body, start + length(body) AS "end", row_number() OVER (PARTITION BY doc_id ORDER BY i) AS unit,
    len(regexp_extract_all(regexp_replace(body, '[\x{{0e00}}-\x{{0eff}}\x{{1000}}-\x{{109f}}\x{{1780}}-\x{{17ff}}\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{20000}}-\x{{3ffff}}]', ' \0 ', 'g'), '[^\x20\x09-\x0D]+')) AS words,
    trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT *, CASE WHEN piece LIKE '%' || chr(10) THEN left(piece, length(piece) - 1) ELSE regexp_replace(piece, '([.!?])[\x20\x09]+$', '\1') END AS body FROM e)
  WHERE regexp_matches(body, '[^\x20\x09-\x0D]')
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, unit) AS place, first_value(doc_id) OVER (PARTITION BY norm ORDER BY doc_id, unit) AS first_doc_id FROM u
),
runs AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM r WHERE place > 1)
SELECT doc_id, min(start)::INT AS start, max("end")::INT AS "end", count(*)::BIGINT AS n_units, sum(words)::BIGINT AS n_words, arg_min(first_doc_id, unit) AS first_doc_id
FROM runs GROUP BY doc_id, run HAVING sum(words) >= {RUN_WORDS}
"""
