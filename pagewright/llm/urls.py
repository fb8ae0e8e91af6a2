"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes.

All of it is DataFrame functions. A url is expanded into the expressions a rule could have (each suffix of the host
at a dot, joined with each prefix of the path that is as long as some rule's path). Expressions meet rules by an
equi-join on the first 32 bits of a SHA-256 digest; the full digests must then agree, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.blocks import saved

#: Fixed values of the contract: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
LOWERED = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    values = ", ".join("({})".format(", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r)) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(verdict, host, path)")


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), *LOWERED), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; '' for null or without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and what is left after each of its dots."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def short(full: Column) -> Column:
    return F.conv(F.substring(full, 1, 8), 16, 10).cast("long")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row.

    Rules are (verdict, host, path) rows. A rule fits its host and subdomains whose path starts with its path. The
    longest rule (host and path) wins; then the longer host, then block before allow. Rows without a fitting rule get
    rule null and the verdict ``otherwise``, as do null urls and urls without ``://`` (host and path ''). Repeated
    rows are judged one by one. Rules with null parts, or without a host, never fit. Columns of ``pages`` that are
    called host, path, rule or verdict are replaced.

    Only the distinct lengths of rule paths come to the driver: at most as many as the longest path has characters.
    The rule of each distinct host and path is written to the scratch folder, so a hot url is one row there.
    Spark broadcasts the rules while they are small; beyond that, adaptive execution splits hot hash prefixes.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("path")).where("path is not null").distinct().collect())
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*own, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    asked = (
        rows.select("host", "path").where("host <> ''").distinct()
        .select("host", "path", F.explode(F.transform(pairs, digest)).alias("digest"))
        .withColumn("short", short(F.col("digest")))
    )
    text = F.concat("host", "path")
    listed = (
        rules.where("host <> '' and path is not null and verdict is not null")
        .select(
            digest(F.concat("host", F.lit("\n"), "path")).alias("full"),
            F.struct(F.length(text).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"), text.alias("rule"), F.col("verdict")).alias("best"),
        )
        .withColumn("key", short(F.col("full")))
    )
    hits = asked.join(listed, (F.col("short") == F.col("key")) & (F.col("digest") == F.col("full")))
    best = saved(hits.groupBy("host", "path").agg(F.max("best").alias("best")), "url-rules")
    b = best.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return rows.join(b, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left").select(
        *own, "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")
    )
