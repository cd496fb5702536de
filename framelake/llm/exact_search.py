"""Exact top-k search by exhaustive term-at-a-time accumulation.

The terms are the components of integer vectors. Queries and candidates are packed into blocks of bounded size, and each pair of blocks is a task of its own: it
inverts the candidates into weighted postings, scatters for each non-zero component of a query its postings into a dense array of scores, and selects the best
of the array by partition. The best of all blocks are merged by rank. A candidate is sent once for each block of queries, a query once for each block of
candidates, so larger blocks send less; nothing is broadcast or collected, and two counts alone reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

SCALE = 256
EVERY, K = 50, 5
QUERIES_PER_BLOCK = ROWS_PER_BLOCK = 32_768
_LONG = np.iinfo(np.int64)
_PACKED = "n int, kind string, begin binary, weights binary, numbers binary, ids binary, missing binary"


def _pack(key: str) -> Callable[[pa.Table], pa.Table]:
    def pack(t: pa.Table) -> pa.Table:
        """One row that holds all vectors of a block in the narrowest integers that fit."""
        t = t.sort_by([("vec_id", "ascending"), ("number", "ascending")]).combine_chunks()  # null ids last: the order of ties
        vectors = t.column("weights").chunk(0)
        weights = vectors.flatten().to_numpy()
        low, high = (int(weights.min()), int(weights.max())) if len(weights) else (0, 0)
        kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        begin = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())]).astype(np.int64)
        ids = t.column("vec_id").cast(pa.int64())
        row = {
            key: t.column(key)[0].as_py(), "n": t.num_rows, "kind": kind, "begin": begin.tobytes(), "weights": weights.astype(kind).tobytes(),
            "numbers": t.column("number").to_numpy().astype(np.int64).tobytes(), "ids": ids.fill_null(0).to_numpy().tobytes(), "missing": ids.is_null().to_numpy().tobytes(),
        }
        return pa.table({k: pa.array([v], pa.int32() if isinstance(v, int) else pa.string() if k == "kind" else pa.binary()) for k, v in row.items()})

    return pack


class _Block:
    def __init__(self, t: pa.Table) -> None:
        row = t.to_pylist()[0]
        self.n = row["n"]
        self.begin = np.frombuffer(row["begin"], np.int64)
        self.weights = np.frombuffer(row["weights"], row["kind"])
        self.numbers, self.ids = np.frombuffer(row["numbers"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.missing = np.frombuffer(row["missing"], bool)

    def most(self) -> int:
        return max(abs(int(self.weights.min())), abs(int(self.weights.max()))) if len(self.weights) else 0

    def widest(self) -> int:
        return int(np.diff(self.begin).max(initial=0))

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a vector, without zeros."""
        own = self.weights[self.begin[k] : self.begin[k + 1]]
        terms = np.flatnonzero(own)
        return terms, own[terms]

    def postings(self, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each term the places of the vectors that have it, and their weights."""
        lengths = np.diff(self.begin)
        owner = np.repeat(np.arange(self.n), lengths)
        term = np.arange(len(self.weights)) - np.repeat(self.begin[:-1], lengths)
        some = self.weights != 0
        owner, term, weights = owner[some], term[some], self.weights[some]
        order = np.argsort(term, kind="stable")
        cuts = np.searchsorted(term[order], np.arange(self.widest() + 1))
        owner, weights = owner[order], weights[order].astype(kind)
        return [(owner[a:b], weights[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _best(queries: _Block, rows: _Block, k: int) -> list[tuple]:
    """(query's number, its id, vec_id, number, score) of the k best rows of the block for each query."""
    bound = queries.most() * rows.most() * min(queries.widest(), rows.widest())
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    postings = rows.postings(kind)
    sums, found = np.zeros(rows.n, kind), []
    for q in range(queries.n):
        sums.fill(0)
        for term, weight in zip(*(x.tolist() for x in queries.row(q)), strict=True):
            if term >= len(postings):
                break
            places, weights = postings[term]
            added = weights * (weight if kind is object else kind(weight))
            if len(places) == rows.n:
                sums += added
            else:
                sums[places] += added
        scores = sums if kind is not object else np.array([min(max(x, _LONG.min), _LONG.max) for x in sums], np.int64)
        take = np.arange(rows.n)
        if rows.n > k + 1:  # one more, for the query itself may be among them
            least = np.partition(scores, rows.n - k - 1)[rows.n - k - 1]
            above = np.flatnonzero(scores > least)
            take = np.concatenate([above, np.flatnonzero(scores == least)[: k + 1 - len(above)]])  # rows stand in the order of ties
        ranked = sorted((-score, place) for score, place in zip(scores[take].tolist(), take.tolist(), strict=True) if rows.numbers[place] != queries.numbers[q])
        query = int(queries.numbers[q]), int(queries.ids[q])
        found += [(*query, None if rows.missing[p] else int(rows.ids[p]), int(rows.numbers[p]), -negative) for negative, p in ranked[:k]]
    return found


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and weights (floor of 256 times each component) of the rows of vectors(vec_id, embedding) whose components are all finite."""
    odd: Callable[[Column], Column] = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    whole = vectors.where(F.col("embedding").isNotNull()).where(~F.exists("embedding", odd))
    return whole.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("weights"))


def top_vectors(vectors: DataFrame, k: int = K, every: int = EVERY, queries_per_block: int = QUERIES_PER_BLOCK, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the greatest inner product for each row of vectors(vec_id, embedding) whose vec_id `every` divides.

    Scores are inner products of the quantised vectors. Equal ones go to the smaller vec_id, a null one last; rows that repeat a vec_id are rows of their own:
    each of them is a query, leaves out itself alone, and finds the others. Null vectors and such with null or non-finite components take no part. Vectors of
    different lengths meet in the components that both have; empty ones score 0. Components and scores beyond a long are its nearest value. Without queries, or
    with a single row, there are no rows.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors).withColumn("number", F.monotonically_increasing_id()), "search_rows")
    is_query = F.col("vec_id") % every == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    row_blocks = max(shuffle_partitions(spark), -(-n // rows_per_block))
    query_blocks = max(1, -(-n_queries // queries_per_block))
    block = lambda seed, blocks: F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(blocks)).cast("int")

    def packed(some: DataFrame, key: str, seed: int, blocks: int) -> DataFrame:
        return written(some.withColumn(key, block(seed, blocks)).groupBy(key).applyInArrow(_pack(key), f"{key} int, {_PACKED}"), key)

    queries, candidates = packed(rows.where(is_query), "query_block", 1, query_blocks), packed(rows, "row_block", 2, row_blocks)
    meeting = lambda blocks, key, n: blocks.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("query_block", "row_block")

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = _best(_Block(asked), _Block(held), k) if asked.num_rows and held.num_rows else []
        names = ("query", "query_id", "vec_id", "number", "score")
        return pa.table({name: pa.array([x[c] for x in found], pa.int64()) for c, name in enumerate(names)})

    met = meeting(queries, "row_block", row_blocks).cogroup(meeting(candidates, "query_block", query_blocks))
    best = met.applyInArrow(search, "query long, query_id long, vec_id long, number long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "number")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
