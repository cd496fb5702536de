"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned with the windows of every document.

The windows of the benchmark are a bounded literal of the plan (see `max_set`), tested inside each row: a document's windows are hashed, looked up in the hash
set, and each hit is verified word by word. Nothing is shuffled, so no group of documents can become hot. The hashes of a larger benchmark are broadcast as a table
(see `_hits_by_join`), and only beyond MAX_BROADCAST windows do hashes meet in a shuffle join that Spark may split.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, alnum_words, ascii_lower, let

WINDOW = 10
#: Windows up to which the benchmark is a literal of the plan, at about 150 bytes each.
MAX_SET = 50_000
#: Windows up to which their hashes, of 8 bytes each, are broadcast.
MAX_BROADCAST = 20_000_000
_BUCKETS = 1024
_NO_HITS = "array<struct<start:int,size:int,items:array<string>>>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """size, words and the sorted item_ids (as strings) of each distinct window of benchmark(item_id, text). Items without words, or null, have none."""
    size = F.least(F.lit(window), F.size("words"))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), alnum_words(ascii_lower(F.col("text"))).alias("words"))
        .where(F.size("words") > 0)
        .select("item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))).alias("window"))
        .groupBy("size", "window")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _starts(words: Column, size: int) -> Column:
    """1-based starts of the windows of a size."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))


def _hits_by_set(words: Column, rows: list, window_sizes: list[int], spark) -> Column:
    """Verified hits, as _NO_HITS, by start. words: lower-cased."""
    hashed = spark.createDataFrame([(r["window"],) for r in rows], "window string").select(F.xxhash64(F.split("window", " ")).alias("h")).collect()
    buckets: list[dict] = [{} for _ in range(_BUCKETS)]
    for r, h in zip(rows, hashed, strict=True):
        buckets[h["h"] % _BUCKETS][r["window"]] = r["items"]
    known = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<string>>>")

    def of_size(n: int) -> Column:
        own = sorted({h["h"] for r, h in zip(rows, hashed, strict=True) if r["size"] == n})
        maybe = F.filter(_starts(words, n), lambda i: F.xxhash64(F.slice(words, i, n)).isin(own))

        def verified(i: Column) -> Column:
            bucket = F.element_at(known, F.pmod(F.xxhash64(F.slice(words, i, n)), F.lit(_BUCKETS)).cast("int") + 1)
            return F.struct((i - 1).cast("int").alias("start"), F.lit(n).alias("size"), F.try_element_at(bucket, F.array_join(F.slice(words, i, n), " ")).alias("items"))

        return F.filter(F.transform(maybe, verified), lambda x: x["items"].isNotNull())

    found = [of_size(n) for n in window_sizes]
    return F.array_sort(found[0] if len(found) == 1 else F.concat(*found))


def _hits_by_join(docs: DataFrame, windows: DataFrame, sizes: list[int], max_broadcast: int) -> DataFrame:
    """docs with hits, by the 8-byte hashes of windows: the benchmark's are broadcast up to max_broadcast of them, so a document's are looked up where they are made; beyond,
    both sides are shuffled. Only places that hit are compared word by word. Rows that repeat a (doc_id, text) share their hits."""
    hashed = windows.select("size", "window", "items", F.xxhash64(F.split("window", " ")).alias("h"))
    small = hashed.count() <= max_broadcast
    known = hashed.select("size", "h").distinct()
    found = None
    for n in sizes:
        own = known.where(F.col("size") == n).select("h")
        starts = F.transform(_starts(F.col("words"), n), lambda i: F.xxhash64(F.slice("words", i, n)))
        places = docs.select("doc_id", "mark", F.posexplode(starts).alias("start", "h")).join(F.broadcast(own) if small else own, "h", "left_semi").withColumn("size", F.lit(n))
        found = places if found is None else found.unionByName(places)
    maybe = found.groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")).agg(F.collect_set(F.struct("start", "size")).alias("maybe"))
    same_text = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))
    beside = docs.join(maybe, same_text, "left")
    places = beside.select("of_id", "of_mark", "words", F.explode("maybe").alias("at")).select("of_id", "of_mark", "at.start", "at.size", F.array_join(F.slice("words", F.col("at.start") + 1, F.col("at.size")), " ").alias("window"))
    verified = places.distinct().join(hashed.drop("h"), ["size", "window"]).groupBy("of_id", "of_mark").agg(F.array_sort(F.collect_set(F.struct("start", "size", "items"))).alias("hits"))
    return docs.join(verified, same_text, "left").select("row", "doc_id", "text", "words", F.coalesce("hits", F.array().cast(_NO_HITS)).alias("hits"))


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, text, words (lower-cased, in order) and hits (start, size, items of each place where a window of the benchmark occurs) of each row of docs, beside the row.

    A window is `window` consecutive words of an item; an item of fewer words, but some, is one window. Null and wordless texts have no words and no hits;
    an empty benchmark gives no hits. A null item_id hits, but is counted as no item. Rows that repeat are judged one by one.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, window)
    base = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", alnum_words(ascii_lower(F.col("text"))).alias("words"))
    rows = windows.limit(max_set + 1).collect()  # bounded: a larger benchmark isn't collected
    if not rows:
        return base.withColumn("hits", F.array().cast(_NO_HITS))
    sizes = sorted({r["size"] for r in rows} if len(rows) <= max_set else {r["size"] for r in windows.select("size").distinct().collect()})
    if len(rows) <= max_set:
        return base.withColumn("hits", _hits_by_set(F.col("words"), rows, sizes, spark))
    return _hits_by_join(base.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit("")))), windows, sizes, max_broadcast)


def report(hits: DataFrame) -> DataFrame:
    """n_words, n_hit (words inside a hit), n_items, items_sha256 and contaminated of each row of with_hits()."""
    items = F.array_sort(F.array_distinct(F.flatten(F.col("hits.items"))))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, h: F.struct(F.greatest(a["end"], h["start"] + h["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), h["start"] + h["size"] - F.greatest(a["end"], h["start"]))).alias("n")),
        lambda a: a["n"],
    )
    return hits.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _without(hits: Column) -> Column:
    """The text of a row of with_hits() without the words inside hits; each goes with what stands between it and the word before."""
    pieces = F.regexp_extract_all(F.col("text"), F.lit(rf"(?s)(?:{NON_WORD})?(?:(?!{NON_WORD}).)+"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(hits, lambda h: (i >= h["start"]) & (i < h["start"] + h["size"])))
    tail = F.regexp_extract("text", rf"(?:{NON_WORD})?\z", 0)
    return F.when(F.size(hits) == 0, F.col("text")).otherwise(F.ltrim(F.concat(F.array_join(kept, ""), tail)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = 0.5, max_set: int = MAX_SET, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with hit words cut out of text; documents with more than drop_share of their words hit are gone. Other rows, and all other columns, are as they were."""
    found = with_hits(docs, benchmark, window, max_set, max_broadcast)

    def outcome(hits: Column) -> Column:
        """The new text as the one element of an array, which is empty for a document that goes: a generator, unlike a filter, has the hits computed once."""
        n_hit = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1)))))
        stays = (F.size(hits) == 0) | (n_hit <= drop_share * F.size("words"))
        return F.when(stays, F.array(F.struct(_without(hits).alias("text")))).otherwise(F.array().cast("array<struct<text:string>>"))

    out = found.select("row", F.explode(let(F.col("hits"), outcome)).alias("out"))
    return out.select(*[F.col("out.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
