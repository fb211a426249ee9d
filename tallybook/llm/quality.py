"""Quality rules (operator 8): a table of thresholds compiled into one projection, without user functions.

A rule bounds a count as a percentage of another count, in whole numbers, so no rounding decides. The
projection is one pass over a row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WHITE, table

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    "a an and are as at be by for from had has have he her his in is it not of on or she that the they this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "als auch auf aus das dem den der des die ein eine er es für im ist mit nicht sich sie und von wie zu zum "
    "al como con del el ella en es la las lo los más no para pero por se sin su un una y".split()
)


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * count / of <= high``, where both are counts of the document; a bound may be None."""

    name: str
    count: str
    of: str
    low: int | None
    high: int | None

    def passes(self) -> Column:
        size, of = 100 * F.col(self.count), F.col(self.of)
        tests = [size >= self.low * of] * (self.low is not None) + [size <= self.high * of] * (self.high is not None)
        return reduce(lambda a, b: a & b, tests)


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("exclamations", "n_exclamations", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
)
BASE_WORDS, BASE_REPEATS = 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_stop_words")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules bound; a null text has no words and no lines.

    8-word windows are hashed by doubling: hashes of 1, 2, 4, then 8 words. Only texts in which two windows
    have equal hashes are sorted. Columns of ``docs`` that are called like the new ones are replaced.
    """
    keep = [c for c in docs.columns if c not in COUNTS]
    out = docs.select(F.struct(*[f"`{c}`" for c in keep]).alias("_row"), F.col(f"`{text}`").alias("_given"))
    out = out.withColumn("_text", F.coalesce(F.col("_given").cast("string"), F.lit("")))
    out = out.withColumn("_words", F.expr(rf"array_remove(split(_text, '[\\x20\\x09-\\x0D]+'), '')"))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    shift = "zip_with(slice({0}, 1, greatest(size({0}) - {1}, 0)), slice({0}, {1} + 1, greatest(size({0}) - {1}, 0)), (a, b) -> xxhash64(a, b))"
    out = out.withColumn("_h1", F.expr("transform(_words, x -> xxhash64(x))"))
    for width in (1, 2, 4):
        out = out.withColumn(f"_h{2 * width}", F.expr(shift.format(f"_h{width}", width)))
    # places of windows that have an equal neighbour once they are sorted by hash
    out = out.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_h8)) < size(_h8) THEN array_sort(transform(_h8, (h, i) -> struct(h, i))) ELSE slice(transform(_h8, (h, i) -> struct(h, i)), 1, 0) END"))
    out = out.withColumn("_left", F.expr("zip_with(_sorted, slice(_sorted, 2, size(_sorted)), (x, y) -> coalesce(x.h = y.h, false))"))
    places = "filter(zip_with(zip_with(_left, concat(array(false), _left), (x, y) -> x OR y), _sorted, (t, x) -> if(t, x.i, null)), x -> x IS NOT NULL)"
    out = out.withColumn("_places", F.expr(f"array_sort({places})"))
    covered = "aggregate(zip_with(_places, slice(_places, 2, size(_places)), (x, y) -> coalesce(least(8, y - x), 8)), 0L, (t, x) -> t + x)"
    return out.select(
        "_row.*",
        "n_words",
        (F.length("_text") - F.regexp_count("_text", F.lit(WHITE))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_exclamations"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with all columns, the counts, ``base_failed``, ``failed`` (names of rules) and ``kept``.

    The base fails texts under 20 words, or with over 30 % of the words in repeated 8-word windows; null and
    empty texts are among these. A text is kept if neither the base nor a rule fails it. Rows are judged one
    by one, so repeated rows are judged alike; an empty table gives no rows. Columns of ``docs`` that are called
    like the new ones are replaced.
    """
    new = {*COUNTS, "base_failed", "failed", "kept"}
    inner = docs.select(F.struct(*[f"`{c}`" for c in docs.columns if c not in new]).alias("row"), F.col(f"`{text}`").alias("text"))
    counted = with_counts(inner)
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    counts = [c for c in counted.columns if c not in ("row", "text")]
    return counted.select("row.*", *counts, base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the counts and the verdict of every document."""
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 8)) AS u(k) GROUP BY r),
c AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
  FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATS} * n_words AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(" AND ".join([f"100 * {r.count} >= {r.low} * {r.of}"] * (r.low is not None) + [f"100 * {r.count} <= {r.high} * {r.of}"] * (r.high is not None)) for r in RULES)} AS kept
FROM b
"""
