"""URL filter lists by hashed host-suffix and path-prefix expressions.

Every URL expands into (host suffix, path prefix) expressions, no deeper than the deepest rule. An
equi-join on the first 4 bytes of SHA-256 finds candidates, the full digest confirms them, and the
longest rule wins. Only Spark SQL functions are used.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and gets
the default verdict. Repeated rows are judged alike. A rule's path ends in ``/``; others are refused.
Of rules of equal length the one with the longer host wins, then the alphabetically first, then
``block``. An empty rule table gives every page the default. Extra columns of ``pages`` are kept
unless an output column has the same name, which then replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that pages of one URL are dealt to.
DEALS = 32
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The production rules (host, path, action).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def _short(digest):
    return F.substring(digest, 1, 8)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    bad = rules.filter(~F.col("path").endswith("/") | F.col("host").isNull() | F.col("path").isNull())
    if not bad.isEmpty():
        raise ValueError("a rule needs a host and a path that ends in /")
    # How deep any rule reaches bounds the expressions of a URL, however long it is.
    deep = rules.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("h"),
        F.coalesce(F.max(F.size(F.split("path", "/")) - 1), F.lit(0)).alias("p"),
    ).first()
    listed = rules.select(
        F.concat("host", "path").alias("_rule"),
        F.col("action").alias("_action"),
        F.length("host").alias("_host_len"),
        F.sha2(F.concat("host", "path"), 256).alias("_digest"),
    ).withColumn("_short", _short("_digest"))

    # A page is its URL and a struct of its columns, whose names then clash with none of those made here. Pages
    # without a host stay out of the join, so that they do not meet in one task.
    pages_ = pages.select(F.col(f"`{url}`").alias("_url"), F.struct(*[F.col(f"`{c}`").alias(c) for c in pages.columns]).alias("_row"))
    hosted = F.coalesce(F.col("_url").contains("://"), F.lit(False))
    urls = pages_.filter(hosted).select("_url")
    split = urls.select("_url", F.split(host_of("_url"), r"\.").alias("_labels"), F.split(path_of("_url"), "/").alias("_parts"))
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(max(1, deep.h)))),
        lambda k: F.array_join(F.slice("_labels", -k, k), "."),
    )
    # "/a/b" has the parts "", "a", "b" and the prefixes "/", "/a/"; a path without "/" has none.
    n = F.least(F.size("_parts") - 1, F.lit(deep.p))
    paths = F.when(n >= 1, F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda k: F.concat(F.array_join(F.slice("_parts", 1, k), "/"), F.lit("/")),
    ))
    said = (
        split.select("_url", F.explode(hosts).alias("_h"), paths.alias("_paths"))
        .select("_url", "_h", F.explode("_paths").alias("_p"))
        .select("_url", F.sha2(F.concat("_h", "_p"), 256).alias("_full"))
    )
    hits = (
        said.withColumn("_short", _short("_full"))
        .join(listed, "_short")
        .filter(F.col("_full") == F.col("_digest"))
        .groupBy("_url")
        .agg(F.min(F.struct(
            (-F.length("_rule")).alias("a"), (-F.col("_host_len")).alias("b"), F.col("_rule").alias("rule"),
            F.when(F.col("_action") == "block", 0).otherwise(1).alias("c"), F.col("_action").alias("action"),
        )).alias("_best"))
    )
    # A URL that many pages have is dealt to DEALS tasks by what else its pages hold.
    hits = hits.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    told = [F.col(f"_row.`{c}`") for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = pages_.filter(hosted).withColumn("_deal", F.pmod(F.xxhash64(*told), F.lit(DEALS)).cast("int"))
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    none = pages_.filter(~hosted).withColumn("_best", F.lit(None).cast(hits.schema["_best"].dataType))
    return (
        dealt.join(hits, ["_url", "_deal"], "left").select("_url", "_row", "_best").union(none.select("_url", "_row", "_best"))
        .select(
            *[F.col(f"_row.`{c}`").alias(c) for c in keep],
            host_of("_url").alias("host"),
            path_of("_url").alias("path"),
            F.col("_best.rule").alias("rule"),
            F.coalesce("_best.action", F.lit(default)).alias("verdict"),
        )
    )
