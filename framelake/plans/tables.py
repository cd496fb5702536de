"""Queries over annotation tables: scans with negatives, filters, re-indexing, cascades, set operations, texts, messages and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import scores, text
from framelake.operators import filters

from .views import OBJECTS_SQL, objects, table

r6 = lambda c: F.round(c, 6)


def category_chunks(spark, d):
    """Categories (brands) in order, in chunks of 4, and one query for each region and category, with or without parts of it."""
    names = table(spark, d, "part").select("p_brand").distinct()
    n = F.row_number().over(Window.orderBy("p_brand"))  # as many rows as there are categories
    chunks = names.withColumn("chunk", F.floor((n - 1) / 4).cast("long"))
    sizes = table(spark, d, "part").select("p_brand", (F.col("p_size") % 5).cast("long").alias("image_id"))
    have = sizes.groupBy("image_id", "p_brand").agg(F.count("*").alias("n_objects"))
    images = sizes.select("image_id").distinct()
    return images.crossJoin(F.broadcast(chunks)).join(have, ["image_id", "p_brand"], "left").na.fill(0, ["n_objects"]).select("image_id", "chunk", F.col("p_brand").alias("category"), "n_objects")


def one_based_ids(spark, d):
    """Tables whose ids start at 0 are counted from 1, and the keys that point to them with them."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    moved = lambda df, key: df.agg(F.max(F.when(F.col(key) == 0, 1).otherwise(0)).alias("by"))
    n, r = moved(nation, "n_nationkey"), moved(region, "r_regionkey").withColumnRenamed("by", "rby")
    return nation.join(F.broadcast(n)).join(F.broadcast(r)).select((F.col("n_nationkey") + F.col("by")).cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + F.col("rby")).cast("long").alias("region_id"))


def cascade_filter(spark, d):
    """Videos (orders) of some days, their annotations (lines), and the count of both."""
    kept = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, d, "lineitem").join(kept, "l_orderkey", "left_semi")
    return lines.groupBy(F.col("l_returnflag").alias("source")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_videos"))


def exhaustive_only(spark, d):
    """Instance filter: only exhaustive queries. Pixel filter: unknown passes, false does not."""
    o = table(spark, d, "orders").withColumn("exhaustive", F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False))
    return o.select(F.col("o_orderkey").alias("id"), filters.exhaustive(F.col("exhaustive")).alias("instance_ok"), filters.pixel_exhaustive(F.col("exhaustive")).alias("pixel_ok"))


def unknown_categories(spark, d):
    """What is neither known nor a distractor."""
    parts = table(spark, d, "part")
    known = parts.where("p_size < 10").select("p_type", "p_brand").distinct()
    other = parts.where("p_size > 45").select("p_type", "p_brand").distinct()
    return parts.select("p_type", "p_brand").distinct().subtract(known.union(other)).select(F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))


def dense_ids(spark, d):
    """Pairs of (customer, priority) as new videos, numbered from 1 in order."""
    pairs = table(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct()
    first = Window.partitionBy("bucket").orderBy("o_custkey", "o_orderpriority")
    # Ranks in ranges of the key, and what stands in the ranges before: no single task sorts all pairs.
    ranged = pairs.withColumn("bucket", F.floor(F.col("o_custkey") / 64))
    before = ranged.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.withColumn("k", F.row_number().over(first)).join(before.select("bucket", "before"), "bucket").select((F.col("before") + F.col("k")).cast("long").alias("video_id"), "o_custkey", "o_orderpriority")


def filled_keys(spark, d):
    """Missing names are taken from the dimension."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    own = c.select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, None).otherwise(F.concat(F.lit("own "), F.col("c_nationkey").cast("string"))).alias("name"), "c_nationkey")
    return own.join(n, own.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce("name", "n_name").alias("name"))


def round_robin_chunks(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).cast("long").alias("chunk"), F.floor(F.col("p_partkey") / 4).cast("long").alias("place"))


def merged_results(spark, d):
    """Two evaluators' rows, one row for each key of either."""
    e = table(spark, d, "events")
    a = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("clicks"))
    b = e.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"), r6(F.avg(F.round("value", 2))).alias("mean_value"))
    return a.join(b, "user_id", "full")


def canonical_phrases(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.sha2(text.canonical(F.col("text")), 256).alias("canonical_sha"), F.sha2(text.collapsed(F.col("text")), 256).alias("collapsed_sha"))


def decorated_queries(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.decorated(F.col("p_name"), "a photo of ", ".", ["red widget", " Small Ring "]).alias("phrase"))


def pruned_messages(spark, d):
    return text.pruned_history(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "role")


def message_counts(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("n_user"), F.max(F.length("text")).cast("long").alias("longest"))


def score_formulas(spark, d):
    li = table(spark, d, "lineitem")
    x, y = F.col("l_discount") * 20 - 1, F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    f = scores.focal_loss(x, y)
    return li.groupBy("l_suppkey").agg(r6(F.sum(F.round(f, 9))).alias("focal"), r6(scores.dice_loss(F.round(scores.sigmoid(x), 9), y)).alias("dice"), r6(F.max(scores.inverse_sigmoid(F.col("l_discount") * 10))).alias("top_logit"), r6(F.max(scores.soft_target(F.col("l_discount") * 10, F.col("l_tax") * 10))).alias("top_soft"))


def class_similarity(spark, d):
    """Mean vectors of labels, and each vector's dot product with its own."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return e.join(mean, ["label", "i"]).groupBy("vec_id", "label").agg(F.round(F.sum(F.col("v").cast("double") * F.col("m")), 5).alias("similarity"))


def top_k_accuracy(spark, d):
    """Percent of vectors whose label is among the 2 labels of nearest mean vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    mean = e.groupBy(F.col("label").alias("of"), "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    s = e.join(mean, "i").groupBy("vec_id", "label", "of").agg(F.round(F.sum(F.col("v").cast("double") * F.col("m")), 9).alias("s"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("s"), "of")
    hit = s.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("vec_id").agg(F.max(F.when(F.col("label") == F.col("of"), 1).otherwise(0)).alias("hit"))
    return hit.agg(r6(100 * F.avg("hit")).alias("accuracy"), F.count("*").alias("n"))


def _asked(spark, d):
    """Categories of an image as its queries: a box prompt for some, a phrase, and what is known of their labels."""
    o = objects(spark, d)
    q = o.groupBy("image_id", "category_id").agg(F.max("rf").alias("rf"), F.sum("tax").alias("tax"), F.min("obj").alias("first"))
    known = F.when(F.col("rf") == "R", True).when(F.col("rf") == "N", F.col("tax") % 2 == 0)
    q = q.select("image_id", "category_id", F.when(F.col("tax") % 3 == 0, "geometric").otherwise("name").alias("phrase"), F.when(F.col("tax") % 2 == 0, F.col("tax")).alias("box"), known.alias("instance_exhaustive"), known.alias("pixel_exhaustive"), (F.col("tax") % 4).alias("stage"), "first")
    targets = o.where("tax < 7").select("image_id", "category_id", F.when(F.col("tax") == 1, 0.0).otherwise(F.col("w")).alias("w"), "h", (F.col("w") * F.col("h") / 307200 - F.when(F.col("tax") == 2, 1.0).otherwise(0.0)).alias("area"), ((F.col("rf") == "R") & (F.col("obj") % 5 == 0)).alias("crowd"))
    return q, targets


def screened_queries(spark, d):
    """The rules that each query fails."""
    q, targets = _asked(spark, d)
    return filters.screened(q, targets, ["image_id", "category_id"], 1).select("image_id", "category_id", F.array_join("failed", ",").alias("failed"))


def remaining_queries(spark, d):
    """Queries without a zero box or an empty target, or of stage 0, numbered anew; datapoints that have one of stage 0."""
    q, targets = _asked(spark, d)
    whole = q.join(q.where("stage = 0").select("image_id").distinct(), "image_id", "left_semi")
    drop = F.arrays_overlap("failed", F.array(F.lit("zero_box"), F.lit("empty_target"))) & (F.col("stage") > 0)
    return filters.without_queries(filters.screened(whole, targets, ["image_id", "category_id"], 1), drop, ["image_id"], "category_id", "stage").select("image_id", "category_id", "local_id", "stage")


QUERIES = {f.__name__: f for f in (category_chunks, one_based_ids, cascade_filter, exhaustive_only, screened_queries, remaining_queries, unknown_categories, dense_ids, filled_keys, round_robin_chunks, merged_results, canonical_phrases, decorated_queries, pruned_messages, message_counts, score_formulas, class_similarity, top_k_accuracy)}

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^`{|}~"
_COLLAPSE = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
ORACLE_SQL = {
    "category_chunks": """WITH c AS (SELECT p_brand, CAST(floor((row_number() OVER (ORDER BY p_brand) - 1) / 4) AS BIGINT) AS chunk FROM (SELECT DISTINCT p_brand FROM part)),
        s AS (SELECT p_brand, CAST(p_size % 5 AS BIGINT) AS image_id FROM part), i AS (SELECT DISTINCT image_id FROM s), h AS (SELECT image_id, p_brand, count(*) AS n FROM s GROUP BY ALL)
        SELECT i.image_id, c.chunk, c.p_brand AS category, coalesce(h.n, 0) AS n_objects FROM i CROSS JOIN c LEFT JOIN h ON h.image_id = i.image_id AND h.p_brand = c.p_brand""",
    "one_based_ids": """SELECT CAST(n_nationkey + (SELECT max(CASE WHEN n_nationkey = 0 THEN 1 ELSE 0 END) FROM nation) AS BIGINT) AS id, n_name AS name,
        CAST(n_regionkey + (SELECT max(CASE WHEN r_regionkey = 0 THEN 1 ELSE 0 END) FROM region) AS BIGINT) AS region_id FROM nation""",
    "cascade_filter": """SELECT l_returnflag AS source, count(*) AS n, count(DISTINCT l_orderkey) AS n_videos FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""",
    "exhaustive_only": """WITH o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS e FROM orders) SELECT id, coalesce(e, false) AS instance_ok, NOT (e IS NOT NULL AND NOT coalesce(e, true)) AS pixel_ok FROM o""",
    "unknown_categories": """SELECT DISTINCT p_type AS type, p_brand AS brand FROM part EXCEPT (SELECT p_type, p_brand FROM part WHERE p_size < 10 UNION SELECT p_type, p_brand FROM part WHERE p_size > 45)""",
    "dense_ids": """SELECT CAST(row_number() OVER (ORDER BY o_custkey, o_orderpriority) AS BIGINT) AS video_id, o_custkey, o_orderpriority FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)""",
    "filled_keys": """SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'own ' || CAST(c_nationkey AS VARCHAR) END, n_name) AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "round_robin_chunks": "SELECT p_partkey AS id, CAST(p_partkey % 4 AS BIGINT) AS chunk, CAST(floor(p_partkey / 4) AS BIGINT) AS place FROM part",
    "merged_results": """WITH a AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS errors, round(avg(round(value, 2)), 6) AS mean_value FROM events WHERE event_type = 'error' GROUP BY 1)
        SELECT user_id, clicks, errors, mean_value FROM a FULL JOIN b USING (user_id)""",
    "canonical_phrases": f"""SELECT doc_id, sha256({_COLLAPSE.format(f"lower(translate(replace(text, '_', ' '), '{_PUNCT}', ''))")}) AS canonical_sha, sha256({_COLLAPSE.format("text")}) AS collapsed_sha FROM documents""",
    "decorated_queries": """SELECT p_partkey, CASE WHEN p_name <> 'geometric' AND lower(trim(p_name)) IN ('red widget', 'small ring') THEN 'a photo of ' || p_name || '.' ELSE p_name END AS phrase FROM part""",
    "pruned_messages": """WITH m AS (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, turn, role FROM m WHERE k <= 2 OR turn >= l""",
    "message_counts": """SELECT conv_id, count(*) AS n, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n_user, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations GROUP BY 1""",
    "score_formulas": """WITH v AS (SELECT l_suppkey, l_discount, l_tax, 1 / (1 + exp(-(l_discount * 20 - 1))) AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
        f AS (SELECT *, round((0.25 * y + 0.75 * (1 - y)) * -(y * ln(p) + (1 - y) * ln(1 - p)) * pow(1 - (p * y + (1 - p) * (1 - y)), 2.0), 9) AS focal, round(p, 9) AS rp, least(greatest(l_discount * 10, 0.0), 1.0) AS c FROM v)
        SELECT l_suppkey, round(sum(focal), 6) AS focal, round(1 - (2 * sum(rp * y) + 1) / (sum(rp) + sum(y) + 1), 6) AS dice, round(max(ln(greatest(c, 0.001) / greatest(1 - c, 0.001))), 6) AS top_logit,
        round(max(greatest(pow(l_discount * 10, 0.25) * pow(l_tax * 10, 0.75), 0.01)), 6) AS top_soft FROM f GROUP BY 1""",
    "class_similarity": """WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM e GROUP BY ALL)
        SELECT vec_id, e.label, round(sum(CAST(v AS DOUBLE) * m), 5) AS similarity FROM e JOIN m ON e.label = m.label AND e.i = m.i GROUP BY ALL""",
    "top_k_accuracy": """WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label AS cls, i, avg(CAST(v AS DOUBLE)) AS m FROM e GROUP BY ALL),
        s AS (SELECT vec_id, label, cls, round(sum(CAST(v AS DOUBLE) * m), 9) AS s FROM e JOIN m ON e.i = m.i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) AS k FROM s),
        h AS (SELECT vec_id, max(CASE WHEN label = cls THEN 1 ELSE 0 END) AS hit FROM r WHERE k <= 2 GROUP BY 1) SELECT round(100 * avg(hit), 6) AS accuracy, count(*) AS n FROM h""",
}

_ASKED_SQL = f"""{OBJECTS_SQL}, q AS (SELECT image_id, category_id, max(rf) AS rf, sum(tax) AS tax FROM objs GROUP BY ALL),
    a AS (SELECT image_id, category_id, CASE WHEN tax % 3 = 0 THEN 'geometric' ELSE 'name' END AS phrase, tax % 2 = 0 AS boxed, CASE rf WHEN 'R' THEN true WHEN 'N' THEN tax % 2 = 0 END AS known, CAST(tax % 4 AS BIGINT) AS stage FROM q),
    t AS (SELECT image_id, category_id, count(*) AS n, bool_or(tax = 1) AS zero, bool_or(w * h / 307200 - CASE WHEN tax = 2 THEN 1.0 ELSE 0.0 END < 1e-6) AS empty, bool_or(rf = 'R' AND obj % 5 = 0) AS crowd FROM objs WHERE tax < 7 GROUP BY ALL),
    f AS (SELECT a.*, coalesce(zero, false) AS zero, coalesce(empty, false) AS empty, coalesce(n, 0) > 1 AS many, coalesce(crowd, false) AS crowd, NOT coalesce(known, false) AS open, NOT coalesce(known, true) AS pixels, boxed AND phrase = 'geometric' AND coalesce(n, 0) = 0 AS bad FROM a LEFT JOIN t USING (image_id, category_id))"""
ORACLE_SQL |= {
    "screened_queries": f"""WITH {_ASKED_SQL} SELECT image_id, category_id, concat_ws(',', CASE WHEN zero THEN 'zero_box' END, CASE WHEN empty THEN 'empty_target' END, CASE WHEN many THEN 'too_many' END, CASE WHEN crowd THEN 'crowd' END,
        CASE WHEN open THEN 'not_exhaustive' END, CASE WHEN pixels THEN 'pixel_not_exhaustive' END, CASE WHEN bad THEN 'invalid_geometric' END) AS failed FROM f""",
    "remaining_queries": f"""WITH {_ASKED_SQL}, k AS (SELECT * FROM f WHERE image_id IN (SELECT image_id FROM f WHERE stage = 0) AND NOT ((zero OR empty) AND stage > 0))
        SELECT image_id, category_id, row_number() OVER (PARTITION BY image_id ORDER BY category_id) - 1 AS local_id, dense_rank() OVER (PARTITION BY image_id ORDER BY stage) - 1 AS stage FROM k""",
}
