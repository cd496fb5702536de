"""Substring dedup by level-wise doubling.

A window of `window` words can only repeat where its halves repeat, so the first level looks at windows of half the length, and only at those that stand for
others: of the half windows inside a window, the one with the least hash (the leftmost of equal ones) is its anchor, and equal windows have equal anchors. The
anchors that occur once fall away. Windows whose anchor repeats are candidates of twice the length; for them the full hash and the first place (doc_id, start)
are exchanged, and what is not the first occurrence is removed. Without candidates the second level sends nothing. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import parts
from .shingles import from_planes, from_sorted_planes, planes, sorted_planes, window_hashes, window_owner, word_hashes

WINDOW = 20


def _anchors(half: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each window, where its anchor starts."""
    if not len(starts):
        return starts
    best, place = half[starts], starts.copy()
    for k in range(1, window - window // 2 + 1):
        value = half[starts + k]
        better = value < best
        best = np.where(better, value, best)
        place[better] = starts[better] + k
    return place


def _windows(t: pa.Table, window: int):
    texts = parts.texts_of(t)
    words, counts = word_hashes(texts)
    starts, owner = window_owner(counts, window)
    return texts, words, counts, starts, owner


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of each row of docs(doc_id, text).

    A word goes if it lies in a window of `window` consecutive words whose sequence also starts earlier: in a smaller doc_id, or in the same doc_id further left.
    Rows that repeat a doc_id and text are equal occurrences, and neither is earlier. A null doc_id comes after all others; null texts have no words.
    """
    spark = docs.sparkSession
    n_parts = parts.count(docs)
    n_buckets = parts.buckets(spark, n_parts)
    dealt = parts.dealt(docs, n_parts)
    binary = pa.binary()

    def first_level(t: pa.Table) -> pa.Table:
        _, words, _, starts, _ = _windows(t, window)
        half = window_hashes(words, window // 2)
        places = _anchors(half, starts, window)
        picks = np.sort(parts.fingerprints(half[np.unique(places)]))
        first, times = parts.groups(picks)
        values, times = picks[first], np.minimum(times, 255).astype(np.uint8)
        cuts = parts.bucket_cuts(values, n_buckets, parts.FINGERPRINT_BITS)
        own = [k for k in range(n_buckets) if cuts[k] < cuts[k + 1]]
        part = t.column("part")[0].as_py()
        return parts.table(
            {"part": [part] * len(own), "bucket": own, "prints": [sorted_planes(values[cuts[k] : cuts[k + 1]]) for k in own], "times": [times[cuts[k] : cuts[k + 1]].tobytes() for k in own]},
            part=pa.int32(), bucket=pa.int32(), prints=binary, times=binary,
        )

    def repeated(t: pa.Table) -> pa.Table:
        owners, prints = t.column("part").to_pylist(), [from_sorted_planes(x) for x in t.column("prints").to_pylist()]
        times = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("times").to_pylist()]).astype(np.int64)
        values = np.concatenate(prints)
        order = np.argsort(values, kind="stable")
        first, size = parts.groups(values[order])
        again = np.zeros(len(values), bool)
        again[order] = np.repeat(np.add.reduceat(times[order], first) > 1, size)
        cuts = np.cumsum([0, *map(len, prints)])
        out = [(part, p[again[a:b]]) for part, p, a, b in zip(owners, prints, cuts, cuts[1:], strict=False)]
        out = [(part, p) for part, p in out if len(p)]
        return parts.table({"part": [p for p, _ in out], "prints": [sorted_planes(x) for _, x in out]}, part=pa.int32(), prints=binary)

    def second_level(t: pa.Table, answers: pa.Table) -> pa.Table:
        rows = {"part": [], "bucket": [], "hashes": [], "ids": [], "starts": []}
        kinds = {"part": pa.int32(), "bucket": pa.int32(), "hashes": binary, "ids": binary, "starts": binary}
        if not t.num_rows or not answers.num_rows:
            return parts.table(rows, **kinds)
        known = np.sort(np.concatenate([from_sorted_planes(x) for x in answers.column("prints").to_pylist()]))
        _, words, counts, starts, owner = _windows(t, window)
        half = window_hashes(words, window // 2)
        candidate = parts.member(parts.fingerprints(half[_anchors(half, starts, window)]), known)
        starts, owner = starts[candidate], owner[candidate]
        hashes, ids = window_hashes(words, window)[starts], parts.order_ids(t)[owner]
        inside = starts - (np.cumsum(counts) - counts)[owner]
        order = np.lexsort((inside, ids, hashes))
        first, _ = parts.groups(hashes[order])
        take = order[first]  # the part's first occurrence of each
        hashes, ids, inside = hashes[take], ids[take], inside[take].astype(np.uint32)
        cuts = parts.bucket_cuts(hashes, n_buckets, 64)
        part = t.column("part")[0].as_py()
        for k in range(n_buckets):
            if cuts[k] < cuts[k + 1]:
                own = slice(cuts[k], cuts[k + 1])
                for name, value in zip(rows, (part, k, sorted_planes(hashes[own]), planes(ids[own]), planes(inside[own])), strict=True):
                    rows[name].append(value)
        return parts.table(rows, **kinds)

    def later(t: pa.Table) -> pa.Table:
        owners, hashes = t.column("part").to_pylist(), [from_sorted_planes(x) for x in t.column("hashes").to_pylist()]
        values = np.concatenate(hashes)
        ids = np.concatenate([from_planes(x, np.int64) for x in t.column("ids").to_pylist()])
        starts = np.concatenate([from_planes(x, np.uint32) for x in t.column("starts").to_pylist()])
        order = np.lexsort((starts, ids, values))
        first, size = parts.groups(values[order])
        least = np.repeat(order[first], size)
        behind = np.zeros(len(values), bool)
        behind[order] = (ids[order] != ids[least]) | (starts[order] != starts[least])
        cuts = np.cumsum([0, *map(len, hashes)])
        out = [(part, h[behind[a:b]]) for part, h, a, b in zip(owners, hashes, cuts, cuts[1:], strict=False)]
        out = [(part, h) for part, h in out if len(h)]
        return parts.table({"part": [p for p, _ in out], "hashes": [sorted_planes(x) for _, x in out]}, part=pa.int32(), hashes=binary)

    id_kind = pa.int32() if dict(docs.dtypes)["doc_id"] == "int" else pa.int64()

    def cut(t: pa.Table, answers: pa.Table) -> pa.Table:
        texts, words, counts, starts, owner = _windows(t, window)
        hashes, ids = window_hashes(words, window)[starts], parts.order_ids(t)[owner]
        begin = np.cumsum(counts) - counts
        inside = starts - begin[owner]
        elsewhere = np.sort(np.concatenate([from_sorted_planes(x) for x in answers.column("hashes").to_pylist()])) if answers.num_rows else np.zeros(0, np.uint64)
        removed = parts.member(hashes, elsewhere)
        order = np.lexsort((inside, ids, hashes))
        first, size = parts.groups(hashes[order])
        least = np.repeat(order[first], size)
        removed[order] |= (ids[order] != ids[least]) | (inside[order] != inside[least])
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, starts[removed], 1)
        np.add.at(step, starts[removed] + window, -1)
        gone = np.cumsum(step)[:-1] > 0
        n_removed = np.bincount(np.repeat(np.arange(len(counts)), counts)[gone], minlength=len(counts))
        kept = []
        for k, text in enumerate(texts):
            split = text.split()
            if n_removed[k]:
                split = [w for w, out in zip(split, gone[begin[k] : begin[k] + counts[k]].tolist(), strict=True) if not out]
            kept.append(b" ".join(split).decode())
        return pa.table({"doc_id": t.column("doc_id").cast(id_kind), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    posted = dealt.groupBy("part").applyInArrow(first_level, "part int, bucket int, prints binary, times binary")
    answers = parts.exchanged(posted, repeated, "part int, prints binary")
    posted = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(second_level, "part int, bucket int, hashes binary, ids binary, starts binary")
    answers = parts.exchanged(posted, later, "part int, hashes binary")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_text string"
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(cut, schema)
