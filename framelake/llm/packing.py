"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are cut into tokens where they lie; what is packed are piece lengths, of which there are at most `capacity` different ones. A solution is a set of
bin patterns (the lengths in a bin) with how often each is used: as large as the number of distinct lengths, whatever the number of documents. Islands evolve
solutions in separate Spark tasks and send their elite to the next island after each epoch. Crossover injects whole well-filled bins of the other parent, removes
the bins that would use a document twice, and best-fits the documents that this displaces. The best solution then deals out places: each piece has a rank among
those of its length, counted in salted groups so that a length that many documents share is no single task's work, and the rank names its sequence and offset.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

CAPACITY = 2048
SEPARATOR_ID = 0
#: Chunks of text whose ids a worker keeps, at about 250 bytes each.
CACHED_CHUNKS = 200_000
_END = "\x01"
#: What sends a chunk to the library: control characters, all from modifier letters and combining marks on, a capital whose lower case has two characters, special tokens.
_NOT_PLAIN = re.compile("[\x00-\x09\x0b-\x1f\x7f-\x9f\u0130\u02b0-\U0010ffff]|<\\|")


# ---- tokens


class _Tokens:
    """ids of texts by a word-wise BPE vocabulary of the `tokenizers` library.

    The vocabulary drops white space and merges nothing across it, so a text's ids are those of its chunks between ASCII white space, and chunks come back often.
    Plain chunks (Latin letters without combining marks) are merged by tiktoken over the same vocabulary and merge order, with a byte for the end of a word;
    all others by the library itself.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        config = json.loads(self.library.to_str())
        self.split = regex.compile(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n").findall
        special = {t["id"] for t in config["added_tokens"]}
        visible = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        suffix, end = config["model"]["end_of_word_suffix"], _END.encode()
        ranks = {}
        for token, rank in config["model"]["vocab"].items():
            if rank not in special:
                word = token.endswith(suffix)
                ranks[bytes(byte_of[c] for c in (token[: -len(suffix)] if word else token)) + end * word] = rank
        self.merge = tiktoken.Encoding("words", pat_str=rf"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.line_end = self.merge("\n" + _END)[0]  # stands between chunks
        self.known: dict[bytes, bytes] = {}

    def _learn(self, chunks: list[bytes]) -> None:
        joined = "\n".join([c.decode() for c in chunks])
        if _NOT_PLAIN.search(joined):
            odd = [c for c in chunks if _NOT_PLAIN.search(c.decode())]
            for c in odd:
                ids = self.library.encode(c.decode(), add_special_tokens=False).ids
                self.known[c] = np.array(ids, "<u4").tobytes()
            chunks = list(set(chunks) - set(odd))
            joined = "\n".join([c.decode() for c in chunks])
        if chunks:
            words = self.split(joined.lower())
            ids = np.array(self.merge(_END.join(words) + _END), "<u4")
            cuts = [0, *(4 * np.flatnonzero(ids == self.line_end) + 4).tolist(), 4 * len(ids) + 4]
            data = ids.tobytes()
            self.known.update(zip(chunks, (data[i : j - 4] for i, j in zip(cuts, cuts[1:])), strict=True))

    def of(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [text.encode().split() for text in texts]
        met = set(itertools.chain.from_iterable(split))
        if len(self.known) > CACHED_CHUNKS:
            self.known.clear()
        if missing := list(met.difference(self.known)):
            self._learn(missing)
        ids = self.known.__getitem__
        return [b"".join(map(ids, chunks)) for chunks in split]


_tokens = functools.cache(_Tokens)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    tokens, last = _tokens(path), SEPARATOR_ID.to_bytes(4, "little")
    for b in batches:
        rows: list[list] = [[], [], [], [], []]
        texts = [t or "" for t in b.column("text").to_pylist()]
        ends = np.cumsum([len(t) for t in texts]) // 2_000_000  # parts of about 2 MB of text
        parts = (tokens.of([texts[k] for k in np.flatnonzero(ends == part)]) for part in np.unique(ends))
        for k, of_text in enumerate(itertools.chain.from_iterable(parts)):
            ids = memoryview(of_text + last)
            n = len(ids) // 4
            for piece, start in enumerate(range(0, n, capacity)):
                end = min(n, start + capacity)
                for column, value in zip(rows, (k, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])), strict=True):
                    column.append(value)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array(rows[0], pa.int32())), *(pa.array(r, t) for r, t in zip(rows[1:], kinds, strict=True))],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of docs(doc_id, text); a null text is empty and has the separator alone."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _pieces(batches, tokenizer_path, capacity), schema)


# ---- solutions: {pattern: uses}, a pattern being a tuple of lengths, longest first


def _take(left: Counter, pattern: Counter, uses: int) -> None:
    for size, n in pattern.items():
        left[size] -= n * uses
        if not left[size]:
            del left[size]


def _best_fit(left: Counter, solution: Counter, capacity: int, rng: random.Random | None = None) -> None:
    """Puts what is left into the fullest bins that take it, longest lengths first, then into new bins; both for all uses of a pattern at once.

    rng: if given, new bins begin with a length drawn among the longest, for another solution each time.
    """
    sizes = sorted(left)

    def largest(room: int, used: Counter) -> int:
        k = bisect.bisect_right(sizes, room)
        while k:
            k -= 1
            if left.get(sizes[k], 0) > used.get(sizes[k], 0):
                return sizes[k]
        return 0

    open_bins = sorted((capacity - sum(p), p) for p in solution if capacity - sum(p) >= (sizes[0] if sizes else capacity + 1))
    for room, pattern in open_bins:
        while left and solution.get(pattern):
            added, free = Counter(), room
            while size := largest(free, added):
                added[size] += 1
                free -= size
            if not added:
                break
            uses = min([solution[pattern], *(left[s] // n for s, n in added.items())])
            _take(left, added, uses)
            solution[pattern] -= uses
            solution[tuple(sorted([*pattern, *added.elements()], reverse=True))] += uses
        if pattern in solution and not solution[pattern]:
            del solution[pattern]
    while left:
        sizes = [s for s in sizes if left.get(s, 0) > 0]
        first = sizes[-1] if rng is None else sizes[max(0, len(sizes) - 1 - int(rng.expovariate(0.5)))]
        bin_, free = Counter([first]), capacity - first
        while size := largest(free, bin_):
            bin_[size] += 1
            free -= size
        uses = min(left[s] // n for s, n in bin_.items())
        _take(left, bin_, uses)
        solution[tuple(sorted(bin_.elements(), reverse=True))] += uses


def _bins(solution: Counter) -> int:
    return sum(solution.values())


def _fitness(solution: Counter, capacity: int) -> tuple:
    """Fewer bins first; then fuller ones, which leave room together."""
    return _bins(solution), -sum(uses * (sum(p) / capacity) ** 2 for p, uses in solution.items())


def _crossover(a: Counter, b: Counter, counts: Counter, capacity: int, rng: random.Random) -> Counter:
    left, child = Counter(counts), Counter()
    least = rng.choice([capacity, capacity - 1, capacity * 0.999, capacity * 0.99])
    for parent, chosen in ((b, True), (a, False)):
        for pattern, uses in parent.items():
            if chosen:  # whole well-filled bins of the other parent
                if sum(pattern) < least or rng.random() < 0.5:
                    continue
            parts = Counter(pattern)
            uses = min([uses, *(left.get(s, 0) // n for s, n in parts.items())])  # those that are used already fall out
            if uses > 0 and (chosen or sum(pattern) >= 0.9 * capacity or rng.random() < 0.5):
                _take(left, parts, uses)
                child[pattern] += uses
    _best_fit(left, child, capacity, rng if rng.random() < 0.5 else None)
    return child


def _evolve(counts: Counter, population: list[Counter], capacity: int, seed: int, generations: int, size: int) -> list[Counter]:
    rng = random.Random(seed)
    while len(population) < size:
        one, left = Counter(), Counter(counts)
        _best_fit(left, one, capacity, rng)  # no greedy packing of its own: crossover makes the good ones
        population.append(one)
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    for _ in range(generations):
        population.sort(key=lambda x: _fitness(x, capacity))
        if _bins(population[0]) == least:
            break
        a, b = rng.sample(population[: max(2, size // 2)], 2)
        child = _crossover(a, b, counts, capacity, rng)
        if _fitness(child, capacity) < _fitness(population[-1], capacity):
            population[-1] = child
    return sorted(population, key=lambda x: _fitness(x, capacity))


def _dump(solution: Counter) -> str:
    return json.dumps([[list(p), n] for p, n in sorted(solution.items())])


def _load(text: str) -> Counter:
    return Counter({tuple(p): n for p, n in json.loads(text)})


def best_patterns(spark, counts: dict[int, int], capacity: int = CAPACITY, islands: int = 6, epochs: int = 2, generations: int = 12, population: int = 6, seed: int = 7) -> Counter:
    """The best solution of the islands for lengths and how often each occurs. A solution, and so all that islands send, grows with the distinct lengths alone."""
    if not counts:
        return Counter()
    schema = "island int, rank int, bins long, solution string"

    def epoch(own: pd.DataFrame, number: int) -> pd.DataFrame:
        island, start = int(own["island"].iloc[0]), [_load(x) for x in own.sort_values("rank")["solution"] if x]
        found = _evolve(Counter(counts), start, capacity, seed + 1000 * number + island, generations, population)
        return pd.DataFrame([(island, k, _bins(x), _dump(x)) for k, x in enumerate(found)], columns=["island", "rank", "bins", "solution"])

    state = spark.range(islands).select(F.col("id").cast("int").alias("island"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("bins"), F.lit("").alias("solution"))
    for number in range(epochs):
        placed = state.repartitionByRange(islands, "island")
        state = written(placed.groupBy("island").applyInPandas(functools.partial(epoch, number=number), schema), "islands")
        if number + 1 < epochs:  # the elite goes on to the next island, in place of that island's worst
            elite = state.where("rank = 0").withColumn("island", ((F.col("island") + 1) % islands).cast("int")).withColumn("rank", F.lit(population - 1))
            state = state.where(F.col("rank") < population - 1).unionByName(elite)
    return _load(state.orderBy("bins", "rank", "island").first()["solution"])


# ---- places


class _Plan:
    """For each length, its runs of places: first rank, first sequence, how many stand in a bin, first offset."""

    def __init__(self, solution: Counter):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        given: Counter = Counter()
        sequence = 0
        for pattern, uses in sorted(solution.items(), reverse=True):
            offset = 0
            for size, n in sorted(Counter(pattern).items(), reverse=True):
                runs.setdefault(size, []).append((given[size], sequence, n, offset))
                given[size] += n * uses
                offset += n * size
            sequence += uses
        self.runs = {size: np.array(r, np.int64) for size, r in runs.items()}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for size in np.unique(lengths):
            own = lengths == size
            runs = self.runs[int(size)]
            run = runs[np.searchsorted(runs[:, 0], ranks[own], "right") - 1]
            inside = ranks[own] - run[:, 0]
            sequence[own] = run[:, 1] + inside // run[:, 2]
            offset[own] = run[:, 3] + inside % run[:, 2] * size
        return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, **islands) -> DataFrame:
    """The pieces of docs(doc_id, text) with their sequence_id and offset.

    Only documents of more than `capacity` tokens are cut. Every piece has one place, sequences are gapless from 0 and never longer than capacity. A null or empty
    text is a piece of the separator alone. Rows that repeat a document are packed each. Without rows there are no pieces.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    salts = shuffle_partitions(spark)
    pieces = written(cut_documents(docs, tokenizer_path, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    by_salt = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = _Plan(best_patterns(spark, counts, capacity, **islands))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # at most salts rows a length
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("own_rank", F.row_number().over(own) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own_rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, schema)
