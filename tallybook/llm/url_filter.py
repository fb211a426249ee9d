"""URL filters (operator 6), with DataFrame functions only.

A URL is expanded into its host's suffixes times those prefixes of its path whose length some rule has. The
expressions meet the rules by the first four bytes of their SHA-256; the whole digest then confirms, and the longest
rule wins. Up to ``in_row`` rules are a map in the plan that each row looks into: nothing is dealt out. With more, the
distinct pairs of host and path are expanded (never whole pages), distinct expressions meet the rules by an equi-join,
and the few that a rule has come back to them; what is replicated for hot hosts and pages is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

CONTRACT_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _expressions(host: Column, path: Column, sizes: list[int]) -> Column:
    """SHA-256, in hex, of each suffix of the host with each prefix of the path that is as long as some rule's."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sizes]).cast("array<string>"), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat(h, F.lit("\n"), p), 256))))


def _short(whole: Column) -> Column:
    return F.conv(F.substring(whole, 1, 8), 16, 10).cast("long")


_SALTS = 16  # copies of a matched rule, so that a hot expression or page is many keys


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", in_row: int = 200) -> DataFrame:
    """``pages`` with all columns and ``host, path, rule, verdict``, one row per row.

    ``rules`` has ``host, path, action``. A rule fits its host and all subdomains if the path starts with the
    rule's. Of those that fit the one with the most characters (host and path) wins, then that with the longer
    host, then ``block``. No rule, or a URL that is null or has no ``://`` (then host and path are empty): the
    default. Rules with a null are ignored, repeated ones count once. Columns of ``pages`` that are called like
    the new ones are replaced. Empty tables are fine.
    """
    new = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in new]
    ruled = rules.where("host is not null and path is not null and action is not null")
    ruled = ruled.select(F.col("host").cast("string"), F.col("path").cast("string"), F.col("action").cast("string")).distinct()
    expression, whole = F.concat("host", "path"), F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    ruled = ruled.select(
        whole.alias("whole"), F.length("path").alias("n"),
        F.struct(F.length(expression).alias("size"), F.length("host").alias("h_size"), F.col("action").alias("action"), expression.alias("rule")).alias("r"),
    )
    # of rules that are alike but for the action one wins anyway
    ruled = ruled.groupBy("whole", "n").agg(F.max("r").alias("r"))
    # the lengths of rule paths: no more than the longest path has characters
    sizes = sorted(r[0] for r in ruled.select("n").distinct().collect())
    few = ruled.limit(in_row + 1).collect()  # so many at most
    rows = pages.select(F.struct(*[f"`{c}`" for c in keep]).alias("_page"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    wholes = _expressions(F.col("host"), F.col("path"), sizes)
    if len(few) <= in_row:
        by_short: dict[int, list] = {}
        for rule in few:
            by_short.setdefault(int(rule["whole"][:8], 16), []).append(F.struct(F.lit(rule["whole"]).alias("whole"), F.struct(*[F.lit(x).alias(k) for k, x in rule["r"].asDict().items()]).alias("r")))
        kind = "array<struct<whole: string, r: struct<size: int, h_size: int, action: string, rule: string>>>"
        entries = [x for short, some in by_short.items() for x in (F.lit(short).cast("long"), F.array(*some).cast(kind))]
        if not entries:
            best = F.lit(None).cast("struct<size: int, h_size: int, action: string, rule: string>")
        else:
            known = F.create_map(*entries)
            hits = F.transform(wholes, lambda w: F.array_max(F.transform(F.filter(known[_short(w)], lambda x: x["whole"] == w), lambda x: x["r"])))
            best = F.array_max(hits)
        got = rows.withColumn("r", best)
    else:
        keys = [F.col("host"), F.col("path")]
        expanded = rows.select("host", "path").distinct().withColumn("whole", F.explode(wholes)).withColumn("short", _short(F.col("whole")))
        once = expanded.select("short", "whole").distinct()
        met = once.join(ruled.select(_short(F.col("whole")).alias("short"), F.col("whole").alias("r_whole"), "r"), "short").where("whole = r_whole").select("short", "whole", "r")
        salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
        fits = expanded.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(_SALTS)).cast("int")).join(met.select("*", salts), ["short", "whole", "salt"])
        best = fits.groupBy("host", "path").agg(F.max("r").alias("r")).select("*", salts)
        got = rows.withColumn("salt", F.pmod(F.xxhash64("_page"), F.lit(_SALTS)).cast("int")).join(best, ["host", "path", "salt"], "left")
    return got.select("_page.*", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", F.lit(default)).alias("verdict"))


def contract_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRACT_RULES, "host string, path string, action string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: ``page_id, host, path, rule, verdict`` for every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), contract_rules(spark)).drop("url")


ORACLE_SQL = r"""
WITH rules(host, path, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
fit AS (
  SELECT p.r, rules.host || rules.path AS rule, rules.action,
         row_number() OVER (PARTITION BY p.r ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC, rules.action DESC) AS nth
  FROM p JOIN rules ON (p.host = rules.host OR suffix(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.r = fit.r AND fit.nth = 1
"""
