"""URL filters: host-suffix and path-prefix expressions of each URL against rules, by short hash prefixes.

Every URL is expanded into the expressions a rule could be written as: each suffix of its host that has as many labels
as some rule's host with each prefix of its path that is as long as some rule's path. Expressions meet rules in an equi-join on the first
32 bits of their SHA-256; the full digests confirm a meeting, and the longest rule wins (at equal length the longer
host, then block). A URL that no rule fits gets the default verdict.

Defined cases: a null URL, or one without ``://``, has an empty host and path and so the default verdict; repeated
rows are judged each; an empty table or rule list gives no row or only default verdicts.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import columns_of

#: Rules up to which their side is broadcast (about 30 MB); longer lists are joined by a shuffle.
BROADCAST_RULES = 200_000
DIGEST_PREFIX = 8


def lower_ascii(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: from there up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, counts: list[int]) -> Column:
    """The suffixes of ``a.b.c`` that have one of ``counts`` labels; nothing for an empty host."""
    labels = F.split(host, r"\.")
    fitting = F.filter(F.array(*map(F.lit, counts)), lambda n: n <= F.size(labels))
    suffixes = F.transform(fitting, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    return F.filter(suffixes, lambda s: s != "")


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The prefixes of ``path`` that have one of ``lengths``."""
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    return F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as rows with their digests."""
    given = spark.createDataFrame([(a, h, p) for a, h, p in rules], "action string, rule_host string, rule_path string").dropDuplicates()
    host = lower_ascii(F.col("rule_host"))
    return given.select(
        "action",
        F.concat(host, F.col("rule_path")).alias("rule"),
        F.length("rule_host").alias("host_length"),
        F.length("rule_path").alias("path_length"),
        F.size(F.split("rule_host", r"\.")).alias("host_labels"),
        F.sha2(expression(host, F.col("rule_path")), 256).alias("rule_digest"),
    )


def expression(host: Column, path: Column) -> Column:
    """What is hashed: host and path, with where the one ends."""
    return F.concat(F.length(host).cast("string"), F.lit(":"), host, path)


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """Per row of ``pages``: its id, host, path, the winning rule (null if none fits) and the verdict."""
    host, path = host_and_path(F.col("url"))
    urls = columns_of(pages, id=id_column, url=url_column).select("id", host.alias("host"), path.alias("path"))
    sizes = rules.agg(F.count("*").alias("n"), F.collect_set("path_length").alias("lengths"), F.collect_set("host_labels").alias("labels")).first()
    if not sizes.n:
        return urls.select(F.col("id").alias(id_column), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # Each distinct host and path is judged once, so repeated URLs are met by one row.
    prefixes = path_prefixes(F.col("path"), sorted(sizes.lengths))
    expressions = F.flatten(F.transform(host_suffixes(F.col("host"), sorted(sizes.labels)), lambda s: F.transform(prefixes, lambda p: expression(s, p))))
    expanded = urls.select("host", "path").distinct().select("host", "path", F.explode(expressions).alias("expression"))
    digests = expanded.select("host", "path", F.sha2("expression", 256).alias("digest"))
    keyed = rules.withColumn("prefix", F.substring("rule_digest", 1, DIGEST_PREFIX))
    if sizes.n <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    met = digests.withColumn("prefix", F.substring("digest", 1, DIGEST_PREFIX)).join(keyed, "prefix").filter("digest = rule_digest")
    rank = F.struct(F.length("rule"), "host_length", F.col("action") == "block", "rule", "action")
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
