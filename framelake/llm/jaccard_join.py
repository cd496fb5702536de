"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its word shingles; two link if their sets' Jaccard similarity reaches a threshold t. What links to a set of n shingles shares at least
T = ceil(t * n) of them. So:

1. Parts post fingerprints of their shingles, buckets count them, and each part learns which of its shingles other sets hold too, and how many do. A document
   with fewer than T shared shingles links with nothing but its equals, and leaves: most do.
2. The others order their shared shingles from the rarest on. The inverted lists of the last ones that are long (at most T - 1 of them) are set aside; the rest are
   merged. A set's equals are one class throughout, and each class is one node.
3. First links, linear in the length of all lists: in each list every node meets a few hubs of the list, and meetings add up to a lower bound of the overlap.
   Groups of near copies fall into components here.
4. Merging: in each merged list, pairs of nodes from different components meet; counts over all lists that reach the required overlap are links.
5. Searching: nodes whose counts fall short but could reach it in the long lists gather in groups, and a group's sets in blocks of bounded size. In each pair of
   blocks every set is a query over the inverted lists of the others: its short lists are merged, the candidates that can still reach the overlap are probed in the
   long ones by binary search (DivideSkip), and those that reach it are links.

Pairs within a component are never counted: they can't change it. No row holds a pair of sets: links leave a task as a spanning forest, pairs to be searched as one
row for each set and task, and each set is sent once for each block of its group. Sets are compared by 64-bit shingle hashes, which decide only between the
shingles of two sets that are compared; equal sets are told by the 64-bit hash of the set.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts
from .common import written
from .components import components
from .shingles import from_planes, from_sorted_planes, mix, planes, sorted_planes, window_hashes, window_owner, word_hashes

WORDS = 5
THRESHOLD = Fraction(3, 4)
#: Lists of more documents than this are long: their shingles are probed, not merged, as far as T allows.
LONG_LIST = 128
#: A group's sets are cut into blocks of SMALL_BLOCK bytes of hashes up to SMALL_BLOCKS of them, and of BLOCK_BYTES beyond; a task has two blocks.
SMALL_BLOCK, SMALL_BLOCKS, BLOCK_BYTES = 1 << 18, 16, 8 << 20


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, and where each text's begin (one more for the end).

    A text of fewer words, but some, has its whole sequence as its one shingle.
    """
    hashes, counts = word_hashes(texts)
    starts, owner = window_owner(counts, words)
    values = window_hashes(hashes, words)[starts] if len(starts) else np.zeros(0, np.uint64)
    begin = np.cumsum(counts) - counts
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        if len(short):
            one = window_hashes(hashes, n)[begin[short]]
            values, owner = np.concatenate([values, mix(one + np.uint64(n))]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_keys(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for empty ones."""
    sizes = np.diff(begin)
    keys = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        sums = np.add.reduceat(mix(values + np.uint64(0x5851F42D4C957F2D)), begin[:-1][some])
        keys[some] = mix(sums + sizes[some].astype(np.uint64))
    return keys


def _first_of_class(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of each class of equal sets in a part; empty sets are left out."""
    some = np.flatnonzero(sizes)
    return np.sort(some[np.unique(keys[some], return_index=True)[1]])


def _rows_of(begin: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the values of the chosen sets, set by set."""
    sizes = np.diff(begin)[chosen]
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin[:-1][chosen], sizes)


_STATE = "doc_id {id}, n long, node long, merged binary, far binary"


def _searched(docs: DataFrame, words: int, t: Fraction, long_list: int, n_parts: int, n_buckets: int) -> DataFrame:
    """Of each row: doc_id, n (its shingles), node (its class), and, for one row of each class and part that can link: hashes to merge and far ones, in hash order."""
    dealt = parts.dealt(docs, n_parts)
    binary = pa.binary()
    id_type = dict(docs.dtypes)["doc_id"]

    def post(p: pa.Table) -> pa.Table:
        values, begin = shingle_sets(parts.texts_of(p, lower=True), words)
        chosen = _first_of_class(set_keys(values, begin), np.diff(begin))
        prints = np.sort(parts.fingerprints(values[_rows_of(begin, chosen)]))
        first, times = parts.groups(prints)
        prints, times = prints[first], np.minimum(times, 2**31 - 1).astype(np.uint32)
        cuts = parts.bucket_cuts(prints, n_buckets, parts.FINGERPRINT_BITS)
        own = [k for k in range(n_buckets) if cuts[k] < cuts[k + 1]]
        part = p.column("part")[0].as_py()
        return parts.table(
            {"part": [part] * len(own), "bucket": own, "prints": [sorted_planes(prints[cuts[k] : cuts[k + 1]]) for k in own], "times": [planes(times[cuts[k] : cuts[k + 1]]) for k in own]},
            part=pa.int32(), bucket=pa.int32(), prints=binary, times=binary,
        )

    def count(p: pa.Table) -> pa.Table:
        owners, prints = p.column("part").to_pylist(), [from_sorted_planes(x) for x in p.column("prints").to_pylist()]
        times = np.concatenate([from_planes(x, np.uint32) for x in p.column("times").to_pylist()]).astype(np.int64)
        values = np.concatenate(prints)
        order = np.argsort(values, kind="stable")
        first, size = parts.groups(values[order])
        total = np.zeros(len(values), np.int64)
        total[order] = np.repeat(np.add.reduceat(times[order], first), size)
        cuts = np.cumsum([0, *map(len, prints)])
        rows = {"part": [], "prints": [], "times": []}
        for part, own, a, b in zip(owners, prints, cuts, cuts[1:], strict=False):
            shared = total[a:b] > 1
            if shared.any():
                rows["part"].append(part)
                rows["prints"].append(sorted_planes(own[shared]))
                rows["times"].append(planes(np.minimum(total[a:b][shared], 2**32 - 1).astype(np.uint32)))
        return parts.table(rows, part=pa.int32(), prints=binary, times=binary)

    def search(p: pa.Table, answers: pa.Table) -> pa.Table:
        values, begin = shingle_sets(parts.texts_of(p, lower=True), words)
        sizes, keys = np.diff(begin), set_keys(values, begin)
        merged: list = [None] * len(sizes)
        far: list = [None] * len(sizes)
        if answers.num_rows and len(values):
            known = np.concatenate([from_sorted_planes(x) for x in answers.column("prints").to_pylist()])
            times = np.concatenate([from_planes(x, np.uint32) for x in answers.column("times").to_pylist()]).astype(np.int64)
            order = np.argsort(known)
            known, times = known[order], times[order]
            prints = parts.fingerprints(values)
            at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
            df = np.where(known[at] == prints, times[at], 1)
            n_shared = np.add.reduceat(np.concatenate([df > 1, [False]]).astype(np.int64), np.minimum(begin[:-1], len(df))) * (sizes > 0)
            for k in _first_of_class(keys, sizes):
                n, m = int(sizes[k]), int(n_shared[k])
                least = math.ceil(t * n)
                if m < least:
                    continue
                own = slice(begin[k], begin[k + 1])
                shared = df[own] > 1
                h, f = values[own][shared], df[own][shared]
                aside = min(int((f > long_list).sum()), least - 1)
                order = np.lexsort((h, f))
                merged[k] = planes(np.sort(h[order[: m - aside]]))
                far[k] = planes(np.sort(h[order[m - aside :]]))
        return pa.table({"doc_id": p.column("doc_id"), "n": pa.array(sizes, pa.int64()), "node": pa.array(keys.view(np.int64)), "merged": pa.array(merged, binary), "far": pa.array(far, binary)})

    posted = dealt.groupBy("part").applyInArrow(post, "part int, bucket int, prints binary, times binary")
    answers = parts.exchanged(posted, count, "part int, prints binary, times binary")
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(search, _STATE.format(id=id_type))


_POSTING = "bucket int, hashes binary, who binary, nodes binary, sizes binary, asides binary, commons binary, components binary"
_MEETING = "bucket int, a binary, b binary, size_a binary, size_b binary, aside binary, shared binary"
#: Numbers that order nodes anew for each hub of a list.
_HUBS = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Meetings that a task holds before it adds them up.
_HELD = 4_000_000
#: Slabs of the partners of a node: hubs have many.
_SLABS, _HUB_SLABS = 8, 4096


def _coded(columns: dict[str, list]) -> dict:
    return {k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in columns.items()}


def _postings(nodes: DataFrame, columns: list[str], n_buckets: int) -> DataFrame:
    """Inverted lists of nodes(node, n, aside, common, component, <blobs of hashes>) by ranges of hashes: for each batch and bucket its hashes, and who holds each, as a
    number among the batch's nodes, which stand beside them."""

    def post(batches):
        for b in batches:
            if not b.num_rows:
                continue
            blobs = [[from_planes(x, np.uint64) for x in b.column(c).to_pylist()] for c in columns]
            per_row = [np.concatenate(x) for x in zip(*blobs, strict=True)]
            hashes, who = np.concatenate(per_row), np.repeat(np.arange(len(per_row), dtype=np.uint32), [len(x) for x in per_row])
            bucket = ((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            about = [b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "aside", "common", "component")]
            rows: dict[str, list] = {name.split()[0]: [] for name in _POSTING.split(", ")}
            for k in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[k] : cuts[k + 1]]
                here, local = np.unique(who[own], return_inverse=True)
                data = (hashes[own], local.astype(np.uint32), *(x[here] for x in about))
                for name, value in zip(rows, (int(k), *map(planes, data)), strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(_coded(rows))

    return nodes.mapInArrow(post, _POSTING)


def _lists(p: pa.Table):
    """The lists of a bucket: hashes and their nodes' numbers, each pair once, by (hash, number); and of each number: node, n, aside, common and component."""
    kinds = (("hashes", np.uint64), ("who", np.uint32), ("nodes", np.int64), ("sizes", np.int32), ("asides", np.int32), ("commons", np.int32), ("components", np.int64))
    h, who, *about = ([from_planes(x, kind) for x in p.column(name).to_pylist()] for name, kind in kinds)
    before = np.cumsum([0, *map(len, about[0])])
    who = np.concatenate([w.astype(np.int64) + k for w, k in zip(who, before, strict=False)])
    node, *about = (np.concatenate(x) for x in about)
    _, first, number = np.unique(node, return_index=True, return_inverse=True)  # parts may each have sent a class
    h, who = np.concatenate(h), number[who]
    order = np.lexsort((who, h))
    h, who = h[order], who[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])
    return h[new], who[new], (node[first], *(x[first] for x in about))


class _Meetings:
    """Pairs of numbers, added up now and then, and sent to where they are summed over all lists."""

    def __init__(self, n: int):
        self.n, self.held, self.waiting = n, [], 0
        self.keys, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append(np.minimum(i, j) * self.n + np.maximum(i, j))
        self.waiting += len(i)
        if self.waiting > _HELD:
            self.sum()

    def sum(self) -> None:
        if not self.held:
            return
        keys, times = np.unique(np.concatenate(self.held), return_counts=True)
        keys, times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])
        order = np.argsort(keys, kind="stable")
        first, _ = parts.groups(keys[order])
        self.keys, self.times = keys[order][first], np.add.reduceat(times[order], first) if len(first) else times
        self.held, self.waiting = [], 0

    def sent(self, about: tuple, n_buckets: int, slabs: int) -> pa.Table:
        """Pairs go by their lesser node and one of so many slabs of the other: what a node is searched for meets in few rows, and no node is one task's work."""
        self.sum()
        i, j = self.keys // self.n, self.keys % self.n
        node, size, aside, *_ = about
        a, b = node[i], node[j]
        slab = mix(b.view(np.uint64)) % np.uint64(slabs)
        bucket = (mix(a.view(np.uint64) ^ mix(slab)) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        columns = (a, b, size[i], size[j], np.maximum(aside[i], aside[j]), self.times.astype(np.int32))
        rows: dict[str, list] = {name.split()[0]: [] for name in _MEETING.split(", ")}
        for k in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[k] : cuts[k + 1]]
            for name, value in zip(rows, (int(k), *(planes(x[own]) for x in columns)), strict=True):
                rows[name].append(value)
        return pa.table(_coded(rows))


def _meet_hubs(n_buckets: int):
    """In each list, every node with the list's hubs: its first node in each of a few orders."""

    def meet(p: pa.Table) -> pa.Table:
        h, who, about = _lists(p)
        first, size = parts.groups(h)
        more = np.repeat(size > 1, size)
        h, who = h[more], who[more]
        met = _Meetings(len(about[0]))
        if len(h):
            first, size = parts.groups(h)
            hubs: list[np.ndarray] = []
            place = np.arange(len(h))
            for turn in _HUBS:
                rank = mix(about[0].view(np.uint64) + turn)[who]
                order = np.lexsort((rank, h))
                hub = np.repeat(order[first], size)
                new = hub != place
                for before in hubs:  # each pair once in a list
                    new &= (hub != before) & (before != place)
                hubs.append(hub)
                at = np.flatnonzero(new)
                met.add(who[hub[at]], who[at])
        return met.sent(about, n_buckets, _HUB_SLABS)

    return meet


def _meet_across(t: Fraction, n_buckets: int):
    """In each list, the pairs of nodes of different components whose sizes allow the threshold."""

    def meet(p: pa.Table) -> pa.Table:
        h, who, about = _lists(p)
        _, n, _, common, component = about
        order = np.lexsort((n[who], h))  # by size within a list: what a node may meet is a run
        h, who = h[order], who[order]
        met = _Meetings(len(n))
        first, size = parts.groups(h)
        of = component[who]
        mixed = np.repeat(np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first), size)
        end = np.repeat(first + size, size)
        live, step = np.flatnonzero(mixed), 0
        while len(live):
            step += 1
            live = live[live + step < end[live]]
            live = live[n[who[live]].astype(np.int64) * t.denominator >= n[who[live + step]].astype(np.int64) * t.numerator]
            across = live[of[live] != of[live + step]]
            x, y = who[across], who[across + step]
            fit = np.minimum(common[x], common[y]) >= _need(n[x], n[y], t)  # what no other set holds can't be in the overlap
            met.add(x[fit], y[fit])
        return met.sent(about, n_buckets, _SLABS)

    return meet


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links (a, b) that connect what all of them connect: each joins a root to a smaller one."""
    if not len(a):
        return np.zeros(0, np.int64)
    _, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    root, taken, live = np.arange(number.max() + 1), [], np.arange(len(a))
    while True:
        low, high = np.minimum(root[x[live]], root[y[live]]), np.maximum(root[x[live]], root[y[live]])
        apart = low != high
        live, low, high = live[apart], low[apart], high[apart]
        if not len(live):
            return np.concatenate(taken) if taken else live
        moved, first = np.unique(high, return_index=True)
        taken.append(live[first])
        root[moved] = low[first]
        while (root[root] != root).any():
            root = root[root]


def _need(n_a: np.ndarray, n_b: np.ndarray, t: Fraction) -> np.ndarray:
    """The least overlap with which sets of these sizes link."""
    return -(-(n_a.astype(np.int64) + n_b) * t.numerator // (t.numerator + t.denominator))


_DECIDED = "kind int, bucket int, a long, x binary, y binary"
#: Kinds of rows: links, links of the graph of pairs to be searched, and what is to be searched for one set.
_LINK, _GROUP, _SEARCH = range(3)
#: Forests that are merged at a time.
_MERGED = 16


def _decided(t: Fraction):
    """Sums of meetings: pairs whose sum reaches the overlap that they need, and those that could with the lists that were set aside."""

    def decide(p: pa.Table) -> pa.Table:
        kinds = (("a", np.int64), ("b", np.int64), ("size_a", np.int32), ("size_b", np.int32), ("aside", np.int32), ("shared", np.int32))
        a, b, size_a, size_b, aside, shared = (np.concatenate([from_planes(x, kind) for x in p.column(name).to_pylist()]) for name, kind in kinds)
        order = np.lexsort((b, a))
        a, b, size_a, size_b, aside, shared = (x[order] for x in (a, b, size_a, size_b, aside, shared))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        total, need = np.add.reduceat(shared.astype(np.int64), first), _need(size_a[first], size_b[first], t)
        a, b = a[first], b[first]
        sure = total >= need
        links, open_ = np.flatnonzero(sure), np.flatnonzero(~sure & (total + aside[first] >= need))
        bucket = p.column("bucket")[0].as_py()
        rows = [(kind, bucket, None, planes(a[k]), planes(b[k])) for kind, own in ((_LINK, links), (_GROUP, open_)) if len(k := own[_spanning(a[own], b[own])])]
        starts, sizes = parts.groups(a[open_])
        rows += [(_SEARCH, bucket, int(a[open_[k]]), planes(b[open_[k : k + n]]), None) for k, n in zip(starts, sizes, strict=True)]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({c.split()[0]: pa.array([r[k] for r in rows], types[k]) for k, c in enumerate(_DECIDED.split(", "))})

    return decide


def _forest(met: DataFrame, kind: int) -> DataFrame:
    """Links(a, b) that connect what those of a kind connect: forests of tasks, merged a few at a time."""

    def merge(p: pa.Table) -> pa.Table:
        a, b = (np.concatenate([from_planes(x, np.int64) for x in p.column(c).to_pylist()]) for c in ("x", "y"))
        some = _spanning(a, b)
        return pa.table({"a": a[some], "b": b[some]})

    return met.where(F.col("kind") == kind).select((F.col("bucket") / _MERGED).cast("int").alias("part"), "x", "y").groupBy("part").applyInArrow(merge, "a long, b long")


def link(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, long_list: int = LONG_LIST, small_block: int = SMALL_BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, itself included) of each row of docs(doc_id, text).

    Texts are lower-cased (A-Z); sets with fewer words than a shingle are one shingle, sets without words are empty and link with nothing. Links are Jaccard similarity
    >= threshold, compared in integers. Rows that repeat a doc_id link as any others. A null doc_id with links takes the least doc_id it reaches, else null.
    """
    n_parts, n_buckets = parts.small(docs)
    state = written(_searched(docs, words, threshold, long_list, n_parts, n_buckets), "shingle-state")
    nodes = state.where("merged is not null").select("node", F.col("n").cast("int").alias("n"), (F.octet_length("far") / 8).cast("int").alias("aside"), ((F.octet_length("merged") + F.octet_length("far")) / 8).cast("int").alias("common"), "merged", "far")

    hubs = _postings(nodes.withColumn("component", F.col("node")), ["merged", "far"], n_buckets).groupBy("bucket").applyInArrow(_meet_hubs(n_buckets), _MEETING)
    first_links = written(_forest(hubs.groupBy("bucket").applyInArrow(_decided(threshold), _DECIDED), _LINK), "first-links")

    placed = nodes.join(components(first_links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    across = _postings(placed, ["merged"], n_buckets).groupBy("bucket").applyInArrow(_meet_across(threshold, n_buckets), _MEETING)
    met = written(across.groupBy("bucket").applyInArrow(_decided(threshold), _DECIDED), "met")
    links = first_links.unionByName(_forest(met, _LINK)).unionByName(_search_blocks(met, nodes, threshold, small_block))

    # Least ids go up from nodes to components and down again, so that copies of one text meet their id in a plain join, which Spark can split.
    own = state.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    own = own.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("least").alias("least"))
    by_node = own.select("node", "component").join(least, "component").select("node", "least")
    found = state.select("doc_id", "n", "node").join(by_node, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


#: The share of DivideSkip's cost model that a probe of a long list takes.
_MU = 0.0085
#: Long lists that are probed before candidates are looked at again.
_PROBED = 16


def _divide_skip(own: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], n_sets: int, wanted: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which of the wanted sets hold as many of the query's hashes as each needs. lists: sorted hashes, where the list of each begins (and the end), the numbers of
    the sets in each list, in order, and (list, number) as one sorted key."""
    hashes, begin, who, keys = lists
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    at = at[hashes[at] == own]
    sizes = begin[at + 1] - begin[at]
    at = at[np.argsort(sizes, kind="stable")]
    least, longest = int(need.min()), int(sizes.max(initial=2))
    n_long = min(len(at), max(0, least - 1), int(least / (_MU * math.log2(max(longest, 2)) + 1)))
    short, long = at[: len(at) - n_long], at[len(at) - n_long :]
    merged = np.concatenate([who[begin[k] : begin[k + 1]] for k in short]) if len(short) else np.zeros(0, who.dtype)
    count = np.bincount(merged, minlength=n_sets)[wanted]
    live = np.flatnonzero(count + n_long >= need)
    for k in range(0, n_long, _PROBED):
        if not len(live):
            break
        probed = long[k : k + _PROBED]
        count[live] += parts.member(probed[:, None] * n_sets + wanted[live], keys).sum(axis=0)
        live = live[count[live] + n_long - k - len(probed) >= need[live]]
    return live


def _search_blocks(met: DataFrame, nodes: DataFrame, t: Fraction, small: int = SMALL_BLOCK) -> DataFrame:
    """Links among the pairs that met() leaves to be searched, as a spanning forest of each pair of blocks."""
    groups = written(components(_forest(met, _GROUP)).withColumnRenamed("component", "group"), "groups")
    sets = nodes.groupBy("node").agg(F.first(F.struct("n", "merged", "far")).alias("s")).select("node", "s.*").join(groups, "node")
    blocks = sets.groupBy("group").agg(F.sum(F.octet_length("merged") + F.octet_length("far")).alias("bytes"))
    blocks = blocks.select("group", F.least(F.ceil(F.col("bytes") / small), F.lit(SMALL_BLOCKS) + F.floor(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    own = F.pmod("node", "n_blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    sent = sets.join(blocks, "group").select("group", own.alias("own"), other.alias("other"), "node", "n", "merged", "far")
    sent = sent.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "merged", "far")
    asked = met.where(F.col("kind") == _SEARCH).select(F.col("a").alias("node"), F.col("x").alias("others")).join(groups, "node").join(blocks, "group")

    def by_block(batches):
        for batch in batches:
            rows: dict[str, list] = {"group": [], "i": [], "j": [], "a": [], "others": []}
            for group, a, n, others in parts.chunks(batch, ["group", "node", "n_blocks", "others"]):
                b = from_planes(others, np.int64)
                block = b % n
                for k in np.unique(block).tolist():
                    for name, value in zip(rows, (group, min(k, a % n), max(k, a % n), a, planes(b[block == k])), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, {"i": pa.int32(), "j": pa.int32(), "others": pa.binary()}.get(k, pa.int64())) for k, v in rows.items()})

    asked = asked.select("group", "node", "n_blocks", "others").mapInArrow(by_block, "group long, i int, j int, a long, others binary")

    def search(held: pa.Table, queries: pa.Table) -> pa.Table:
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if queries.num_rows:
            node, n = held.column("node").to_numpy(), held.column("n").to_numpy().astype(np.int64)
            node, first = np.unique(node, return_index=True)
            n = n[first]
            blobs = [held.column(c).to_pylist() for c in ("merged", "far")]
            own = [np.concatenate([from_planes(x[k], np.uint64) for x in blobs]) for k in first]
            who = np.repeat(np.arange(len(node)), [len(x) for x in own])
            values = np.concatenate(own)
            order = np.lexsort((who, values))
            values, who = values[order], who[order]
            begin, sizes = parts.groups(values)
            lists = values[begin], np.concatenate([begin, [len(values)]]), who, np.repeat(np.arange(len(begin)), sizes) * len(node) + who
            for a, others in parts.chunks(queries, ["a", "others"]):
                k, wanted = int(np.searchsorted(node, a)), np.sort(np.searchsorted(node, from_planes(others, np.int64)))
                hit = wanted[_divide_skip(own[k], lists, len(node), wanted, _need(n[wanted], n[k], t))]
                found_a.append(np.full(len(hit), a, np.int64))
                found_b.append(node[hit])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        some = _spanning(a, b)
        return pa.table({"a": a[some], "b": b[some]})

    return sent.groupBy("group", "i", "j").cogroup(asked.groupBy("group", "i", "j")).applyInArrow(search, "a long, b long")


#: Ids, of 8 bytes each, that are broadcast to drop their documents; more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without those that link to a document of smaller doc_id, near or through others. Rows that repeat a doc_id share its fate; rows without an id stay."""
    gone = written(link(docs, **how).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone, "doc_id", "left_anti")
