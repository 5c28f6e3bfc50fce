"""URL filters: allow and block rules on hosts and path prefixes.

Every URL is expanded into host-suffix + path-prefix expressions. They meet the rules in an
equi-join on the first eight hex digits of their SHA-256; the full digest confirms a match, and
the longest matching rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

PREFIX_CHARS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules ``(host, path, action)`` with rule string, digest and precedence; repeated rules collapse.

    A rule with a null in host or action is ignored; a null path is empty. Of the same host and
    path with both actions, ``block`` wins.
    """
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    clean = rules.select(host.alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("action").alias("r_action")).filter("r_host is not null and r_action is not null")
    merged = clean.groupBy("r_host", "r_path").agg(F.max("r_action").alias("r_action"))
    digest = _digest(F.col("r_host"), F.col("r_path"))
    return merged.select(
        F.concat("r_host", "r_path").alias("r_rule"), "r_action", digest.alias("r_digest"), F.substring(digest, 1, PREFIX_CHARS).alias("r_short"), F.length("r_path").alias("r_len"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = 200_000, broadcast_bytes: int = 64 << 20, salts: int = 32) -> DataFrame:
    """One row per row of ``pages``: ``id_col, host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest
    rule string wins, and where none fits the verdict is ``default``. Null or malformed URLs have
    empty host and path and match nothing. Repeated rows give repeated results, null ids are
    carried, other columns are not. Up to ``broadcast_rules`` rules of ``broadcast_bytes`` are
    broadcast; more are shuffled on the hash prefix, with expressions salted so that a hot host is
    spread. URLs of any length are taken whole: their host gives as many suffixes as it has labels.
    """
    ruled = rule_table(rules)
    lengths = sorted(r["r_len"] for r in ruled.select("r_len").distinct().collect())  # at most as many as the longest path has characters
    held = ruled.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("r_rule") + 128), F.lit(0)).alias("size")).first()  # 128: digests, action, pointers
    small = held["n"] <= broadcast_rules and held["size"] <= broadcast_bytes
    host, path = url_host(F.col(f"`{url_col}`")), url_path(F.col(f"`{url_col}`"))
    # repeated rows are counted task by task, so that none has to bring back very many
    parts = pages.select(F.col(f"`{id_col}`").alias("__id"), host.alias("host"), path.alias("path"), F.spark_partition_id().alias("__task"))

    labels = F.split("host", r"\.", -1)
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    known = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    heads = F.transform(F.filter(known, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))
    # one place per row counts it, so that repeated rows come back as often as they came
    spread = parts.select("*", F.posexplode_outer(expressions).alias("pos", "expression"))
    spread = spread.select("__id", "host", "path", "__task", F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0).alias("one"), F.sha2("expression", 256).alias("digest"))
    spread = spread.withColumn("short", F.substring("digest", 1, PREFIX_CHARS))
    if small:
        met = spread.join(F.broadcast(ruled), F.expr("short = r_short and digest = r_digest"), "left")
    else:
        salted = spread.withColumn("salt", F.pmod(F.xxhash64("__id", "host", "path"), F.lit(salts)).cast("int"))
        copied = ruled.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = salted.join(copied, F.expr("short = r_short and salt = r_salt and digest = r_digest"), "left")
    best = F.max(F.when(F.col("r_rule").isNotNull(), F.struct(F.length("r_rule").alias("n"), F.col("r_rule").alias("rule"), F.col("r_action").alias("action"))))
    judged = met.groupBy("__id", "host", "path", "__task").agg(F.sum("one").alias("n"), best.alias("best"))
    rows = judged.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select(F.col("__id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


#: The rules of the query's contract.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)
