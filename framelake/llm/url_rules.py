"""URL filters by a sort-merge range join over reversed-host keys.

A host `www.example.com` has the key `com.example.www.`; the hosts that a rule host covers (itself and its subdomains) are then the interval of keys
that start with the rule host's key. These intervals nest or are disjoint, so one sorted sweep over interval starts, urls and interval ends, with a stack
of the rules that are open, meets every rule that can fit a url. Rule and url rows are shuffled by (top-level label, salt): no rule spans two top-level labels,
and the salt splits a label or host that holds a large part of the urls. A rule row is copied once for each salt; the cost is rules x salts, linear in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, shuffle_partitions

LAST_CHAR = "\U0010ffff"  # sorts after all that can follow a rule's key


def host_of(url: Column) -> Column:
    """From the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each with a dot after it; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages(page_id, url), by rules(host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's path. Of the rules that fit, the longest (host plus path) wins; of equally
    long ones, that of the deeper host; of equal (host, path) rows, `block`. Without a rule, the verdict is `default`. Null urls, and urls without `://`, have an
    empty host and path and meet no rule. Rules with an empty or null host are ignored; a null rule path is empty. Rows that repeat are judged one by one.
    salts: shuffle partitions of the session, unless given.
    """
    spark = pages.sparkSession
    salts = salts or shuffle_partitions(spark)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(
        "page_id", "host", "path", host_key(F.col("host")).alias("key"), F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int").alias("salt")
    )
    by_host = (
        rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block sorts after allow
        .groupBy("host")
        .agg(F.collect_list(F.struct(F.length(F.concat("host", "path")).alias("size"), "path", F.concat("host", "path").alias("rule"), "verdict")).alias("rules"))
        .select(host_key(F.col("host")).alias("key"), "rules")
    )
    # How many rules can be open at once: at most the labels of the longest rule host. One integer.
    deepest = by_host.agg(F.max(F.size(F.split("key", r"\.")) - 1)).first()[0] or 0
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    starts = by_host.select("key", every_salt, F.lit(1).alias("step"), "rules")
    ends = by_host.select(F.concat("key", F.lit(LAST_CHAR)).alias("key"), every_salt, F.lit(-1).alias("step"), F.lit(None).cast(by_host.schema["rules"].dataType).alias("rules"))
    events = (
        urls.withColumn("step", F.lit(0))
        .unionByName(starts, allowMissingColumns=True)
        .unionByName(ends, allowMissingColumns=True)
        .withColumn("shard", F.substring_index("key", ".", 1))
    )
    # At equal keys a start comes before the urls; an end's key is never that of a url.
    sweep = Window.partitionBy("shard", "salt").orderBy("key", F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.withColumn("depth", F.sum("step").over(sweep))
    for level in range(1, deepest + 1):  # the stack: at each level the rule host that was opened last
        opened = F.when((F.col("step") == 1) & (F.col("depth") == level), F.col("rules"))
        events = events.withColumn(f"open_{level}", F.last(opened, ignorenulls=True).over(sweep))
    no_rule = F.array().cast(by_host.schema["rules"].dataType)
    best = F.lit(None).cast("struct<size:int,level:int,rule:string,verdict:string>")
    for level in range(1, deepest + 1):
        fits = F.filter(F.when(F.col("depth") >= level, F.col(f"open_{level}")).otherwise(no_rule), lambda r: F.startswith(F.col("path"), r["path"]))
        ranked = F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
        longest = F.array_max(ranked)
        here = F.when(longest.isNotNull(), F.struct(longest["size"].alias("size"), F.lit(level).alias("level"), longest["rule"].alias("rule"), longest["verdict"].alias("verdict")))
        best = here if level == 1 else F.greatest(best, here)
    return (
        events.where("step = 0")
        .withColumn("best", best)
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
