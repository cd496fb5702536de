"""How five filters act together: a packed bitmap index, and counts of what every order of the filters keeps and loses.

One pass over the texts leaves a row of a few dozen bytes for each document: which text filters it fails, and a digest of its text. The first document of each
digest is found by aggregation, so copies never meet in one task, and the document's own id tells whether it is that first one. Each partition then packs its
rows into bitsets of filters, labels and parts; AND-NOT and popcount give what each of the 32 sets of filters keeps, and the partitions' counts are summed.
All orders and steps follow from those 32 counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))  # the bytes of UTF-8 that begin no code point
_COPY = 1 << FILTERS.index("E")
_SETS = 1 << len(FILTERS)
_ALL = _SETS - 1
#: Parts whose counts a task holds before it hands them on.
_HELD_PARTS = 4096


def _fails(text: bytes) -> int:
    """Bits of the text filters A to D that a text fails."""
    words = text.split()
    few = len(words) < 200
    repeated = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 2 * len(text.translate(None, _CONTINUED))
    symbols = len(text.translate(None, _SYMBOLS)) < len(text)
    return few | repeated << 1 | loud << 2 | symbols << 3


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("part"), pa.array([_fails(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
            ["doc_id", "part", "fails", "digest"],
        )


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as bitsets of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view(np.uint64)


def set_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, subset, kept, good, toxic) of (part, fails, good, toxic): of each part, the documents that no filter of the subset removes."""

    def out(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        counts = np.concatenate(list(held.values()))
        columns = [pa.array(np.repeat(np.array(list(held), object), _SETS), pa.string()), pa.array(np.tile(np.arange(_SETS, dtype=np.int32), len(held)))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in counts.T)], ["part", "subset", "kept", "good", "toxic"])

    held: dict[str, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        parts = b.column("part").dictionary_encode()
        of_part = parts.indices.to_numpy()
        fails = b.column("fails").to_numpy()
        filters = _packed((fails >> np.arange(len(FILTERS))[:, None] & 1).astype(bool))
        labels = _packed(np.stack([np.ones(b.num_rows, bool), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))]))
        removed = np.zeros((_SETS, filters.shape[1]), np.uint64)
        for s in range(1, _SETS):
            lowest = (s & -s).bit_length() - 1
            removed[s] = removed[s & s - 1] | filters[lowest]
        for k, part in enumerate(parts.dictionary.to_pylist()):
            inside = _packed(of_part == k) & labels
            left = inside[None] & ~removed[:, None]
            held[part] = held.get(part, 0) + np.bitwise_count(left).sum(axis=2, dtype=np.int64)
        if len(held) > _HELD_PARTS:
            yield out(held)
            held = {}
    if held:
        yield out(held)


def document_bits(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of A to E), good and toxic of each row of docs(doc_id, text, source), labels(doc_id, quality, toxic)."""
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    seen = written(own.mapInArrow(_texts, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, fails int, digest binary"), "filter_bits")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    of_label = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    known = labels.groupBy("doc_id").agg(of_label("quality"), of_label("toxic"))
    both = seen.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return both.select(
        "doc_id", "part", F.when(copy, F.col("fails").bitwiseOR(F.lit(_COPY))).otherwise(F.col("fails")).alias("fails"),
        F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def audit_orders(bits: DataFrame) -> DataFrame:
    """One row for each part of bits(part, fails, good, toxic), order of the filters, and step."""
    sets = bits.select("part", "fails", "good", "toxic").sortWithinPartitions("part").mapInArrow(set_counts, "part string, subset int, kept long, good long, toxic long")
    sums = sets.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])
    wide = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("of"))  # 32 entries, by subset
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            steps.append({"o": "".join(order), "s": k + 1, "b": before, "x": 1 << FILTERS.index(f)})
            before |= steps[-1]["x"]
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<o: string, s: int, b: int, x: int>>")
    rows = wide.select("part", "of", F.explode(every).alias("at")).select("part", "of", "at.*")
    at = lambda subset, name: F.col("of")[subset][name]
    x, before = F.col("x"), F.col("b")
    after = before.bitwiseOR(x)
    lost = lambda name, b=before, a=after: at(b, name) - at(a, name)
    shapley: Column = F.lit(0).cast("long")
    for s in range(_ALL):  # a set with the filter itself adds nothing
        weight = factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        shapley = shapley + weight * (at(s, "kept") - at(F.lit(s).bitwiseOR(x), "kept"))
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), at(after, "kept").alias("kept"), lost("kept").alias("removed"),
        (at(0, "kept") - at(x, "kept") - lost("kept")).alias("redundant"), (at(F.lit(_ALL) - x, "kept") - at(_ALL, "kept")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley over docs(doc_id, text, source).

    A text fails A with fewer than 200 words, B if under half of its words differ, C if over 2 % of its code points are A-Z, D with any of #$%&*|, and E if a
    smaller doc_id has the same text. Null texts and sources are empty; an empty text fails A alone, and E. Rows that repeat a doc_id and text are equally
    early; a row without doc_id is later than none, and so never fails E, and makes no other fail it. A document is good or toxic if any of its label rows says
    so; labels of unknown documents count for nothing. No documents give no rows.
    """
    return audit_orders(document_bits(docs, labels))
