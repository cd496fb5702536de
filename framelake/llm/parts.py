"""Passes over a corpus in parts, and the exchange of hashes between parts.

The documents are dealt once into parts by a hash of (doc_id, text); all passes over the texts read that one shuffle again. A part posts each of its distinct
hashes once, however many of its documents share it, so a hash that a third of all documents hold reaches its bucket in as many rows as there are parts.
Buckets are ranges of hash values. A part is held by a task as a whole, so there are as many as the bytes of all texts ask for at PART_BYTES each, and at least
PARTS_PER_TASK for each shuffle partition; buckets grow with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions

PARTS_PER_TASK = 4
PART_BYTES = 64 << 20
FINGERPRINT_BITS = 48
_LAST = np.iinfo(np.int64).max


def count(docs: DataFrame) -> int:
    """How many parts docs(text) is dealt into."""
    return max(PARTS_PER_TASK * shuffle_partitions(docs.sparkSession), -(-_bytes(docs) // PART_BYTES))


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def small(docs: DataFrame) -> tuple[int, int]:
    """How many parts, and how many buckets, if each is to take a quarter of PART_BYTES at most: a bucket of so many texts' hashes, too, is held by a task."""
    n, least = -(-4 * _bytes(docs) // PART_BYTES), shuffle_partitions(docs.sparkSession)
    return max(PARTS_PER_TASK * least, n), max(least, n)


def dealt(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text and part, one of n."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("part"))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The high bits of 64-bit hashes: enough to tell windows of a corpus apart, and shorter to send. Equal ones only add work where the full hash decides."""
    return hashes >> np.uint64(64 - FINGERPRINT_BITS)


def buckets(spark: SparkSession, n: int) -> int:
    """How many buckets take what n parts post."""
    return max(shuffle_partitions(spark), n // PARTS_PER_TASK)


def bucket_cuts(ordered: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where each of n ranges of equal width begins and ends among sorted values of so many bits."""
    edges = np.array([(k << bits) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]])


def texts_of(t: pa.Table, lower: bool = False) -> list[bytes]:
    """UTF-8 texts of a part, null as empty; lower: with A-Z lower-cased."""
    found = [(x or "").encode() for x in t.column("text").to_pylist()]
    return [x.lower() for x in found] if lower else found


def order_ids(t: pa.Table) -> np.ndarray:
    """doc_id as int64 for comparisons; null comes last."""
    return t.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()


def groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each run of equal values."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return first, np.diff(np.concatenate([first, [len(ordered)]]))


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def table(columns: dict[str, list], **kinds: pa.DataType) -> pa.Table:
    return pa.table({name: pa.array(values, kinds[name]) for name, values in columns.items()})


def exchanged(posted: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """answer() for all rows of each bucket of posted(part, bucket, ...)."""
    return posted.groupBy("bucket").applyInArrow(answer, schema)


def chunks(t: pa.Table, names: list[str]) -> Iterator[tuple]:
    yield from zip(*(t.column(n).to_pylist() for n in names), strict=True)
