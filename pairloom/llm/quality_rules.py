"""Quality rules: text statistics and cross-document line frequency.

Lines are normalised and hashed (64 bits), the distinct documents (doc_ids) that hold a line are counted
for every host, and a line that more than `limit` documents of a host hold is removed from all of them but
the first (smallest doc_id), so that of many copies one survives whole. The limit is the same for small and
hot hosts. A document that loses lines is depleted, and rejected, if fewer than `min_words` words or less
than 100 - `depleted_pct` percent of its characters remain.

Edge cases: a null text counts as empty, a null source as the host ''. An empty text has all
statistics 0 and fails the base rules. Rows with the same doc_id count as one document for the limit, and
each is judged by its own text; a null doc_id counts as one document, which is never the first. An empty table
gives an empty result. Columns other than doc_id, text and source are ignored (and kept by `keep_good`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, IN_WORD, computed, settle, table, words_of

MIN_WORDS, REPEAT_PCT = 50, 50
LIMIT, DEPLETED_PCT = 5, 50


def normalise(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(line, GAP, " "), "[0-9]", "0")))


def base_features(docs: DataFrame, min_words: int = MIN_WORDS, repeat_pct: int = REPEAT_PCT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    d = docs.select(F.struct(*keep).alias("kept_"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(
        "kept_",
        words_of(F.col("text")).alias("words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(IN_WORD)).alias("lines"),
    )
    w = F.col("words")
    triples = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    d = d.select(
        "kept_",
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) > 3, triples).alias("triples"),
    )
    # Only a text with some window twice needs to know where its windows are.
    t = F.col("triples")
    d = d.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct(t)) < F.size(t),
            F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    p = F.col("placed")
    twice = F.filter(
        p, lambda x, k: (F.get(p, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(p, k + 1)["h"].eqNullSafe(x["h"]))
    )
    d = d.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return computed(d, "kept_", *names).select("kept_.*", *names)


def _key() -> Column:
    """What tells rows apart for the lines they lose; equal rows lose the same."""
    return F.struct("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))


def frequent_lines(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """key (of _key), what the rows of this key lose by the limit: n_lost, words_lost, chars_lost (line feeds included), and gone, the lines' hashes."""
    own = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(normalise(x).alias("v"), (F.length(x) + 1).alias("chars")))
    n_words = lambda v: F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit(""))) + 1
    found = F.transform(F.filter(own, lambda x: x["v"] != ""), lambda x: F.struct(F.xxhash64(x["v"]).alias("line"), n_words(x["v"]).alias("words"), x["chars"].alias("chars")))
    lines = settle(docs.select(_key().alias("key"), F.posexplode(found).alias("pos", "l")).select("key.*", "pos", "l.*"), "lines")
    # First by occurrences, summed before the shuffle: no line below the limit can pass it by documents.
    often = settle(lines.groupBy("host", "line").count().where(F.col("count") > limit).select("host", "line"), "often")
    held = settle(lines.join(often, ["host", "line"]), "held")
    n = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    over = held.groupBy("host", "line").agg(n.alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > limit)
    lost = held.join(settle(over.select("host", "line", "first"), "over"), ["host", "line"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    once = lost.groupBy("doc_id", "host", "t", "pos", "line").agg(F.first("words").alias("words"), F.first("chars").alias("chars"))  # rows may be repeated
    total = lambda c: F.sum(c).cast("long").alias(f"{c}_lost")
    lost = once.groupBy("doc_id", "host", "t").agg(F.count(F.lit(1)).alias("n_lost"), total("words"), total("chars"), F.collect_set("line").alias("gone"))
    return settle(lost.select(F.struct("doc_id", "host", "t").alias("key"), "n_lost", "words_lost", "chars_lost", "gone"), "gone")


def _judged(base: DataFrame, depleted_pct: int, min_words: int) -> DataFrame:
    """base (statistics, n_chars and losses, where there are any) with n_lines_removed, n_words_left, depleted and kept."""
    none = F.lit(0).cast("long")
    d = base.withColumn("n_lines_removed", F.coalesce("n_lost", none)).withColumn("n_words_left", F.col("n_words") - F.coalesce("words_lost", none))
    few = 100 * F.greatest(none, F.col("text_chars") - F.col("chars_lost")) < (100 - depleted_pct) * F.col("text_chars")
    d = d.withColumn("depleted", F.col("n_lost").isNotNull() & ((F.col("n_words_left") < min_words) | F.coalesce(few, F.lit(False))))
    return d.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def quality_rules(
    docs: DataFrame, limit: int = LIMIT, depleted_pct: int = DEPLETED_PCT, min_words: int = MIN_WORDS, repeat_pct: int = REPEAT_PCT
) -> DataFrame:
    """The statistics, n_lines_removed, n_words_left, depleted, base_failed and kept of every row of docs."""
    lost = frequent_lines(docs, limit).drop("gone")
    d = docs.select(_key().alias("key"), F.length(F.coalesce("text", F.lit(""))).alias("text_chars"), "text")
    d = base_features(d, min_words, repeat_pct, ("key", "text_chars")).join(lost, "key", "left")  # the texts stay where they are
    d = _judged(d, depleted_pct, min_words)
    return d.select("key.doc_id", *[c for c in d.columns if c not in ("key", "text_chars", "n_lost", "words_lost", "chars_lost")])


def keep_good(
    docs: DataFrame, limit: int = LIMIT, depleted_pct: int = DEPLETED_PCT, min_words: int = MIN_WORDS, repeat_pct: int = REPEAT_PCT
) -> DataFrame:
    """The rows of docs that the rules keep, with all columns; text without the lines over the limit, and n_chars, if there, anew for those."""
    d = docs.select(F.struct(*docs.columns).alias("row"), _key().alias("key"), F.length(F.coalesce("text", F.lit(""))).alias("text_chars"), "text")
    d = base_features(d, min_words, repeat_pct, ("row", "key", "text_chars")).where(~F.col("base_failed"))
    d = _judged(d.join(frequent_lines(docs, limit), "key", "left"), depleted_pct, min_words).where("kept")
    rest = F.filter(F.split(F.col("row.text"), "\n", -1), lambda x: ~F.array_contains("gone", F.xxhash64(normalise(x))))
    d = d.withColumn("clean", F.when(F.col("gone").isNotNull(), F.array_join(rest, "\n")))
    new = {"text": F.coalesce("clean", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), "row.n_chars")
    return d.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, text FROM d),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
),
raw AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
norm AS (
  SELECT doc_id, host, line AS own, trim(lower(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')), ' ') AS line
  FROM raw
),
freq AS (
  SELECT host, line, min(doc_id) AS first FROM norm WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT doc_id) > {LIMIT}
),
lost AS (
  SELECT doc_id, count(*) AS n_lines_removed, sum(len(regexp_extract_all(own, '[^\x20\x09-\x0D]+'))) AS words, sum(length(own) + 1) AS chars
  FROM norm JOIN freq USING (host, line) WHERE doc_id <> first GROUP BY doc_id
),
f AS (
  SELECT w.doc_id, len(w.words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, (len(w.words) - coalesce(lost.words, 0))::BIGINT AS n_words_left,
    chars IS NOT NULL AND (n_words_left < {MIN_WORDS} OR 100 * greatest(0, length(text) - chars) < (100 - {DEPLETED_PCT}) * length(text)) AS depleted
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words) AS base_failed, NOT base_failed AND NOT depleted AS kept
FROM f
"""
