"""Source divergence audit: which sources of a language count its terms alike, and which terms a source has more of than its language.

Terms that all sources of a language count alike have the same sparse vector of source counts. They are grouped by it: a pair of sources is evaluated once for
each distinct vector, times the number of its terms, and only at the end are the original terms ranked again. Counting is one pass over the texts with partial
sums in the tasks. The pairs are dealt as cells: a block of sources against a block of sources over a share of the distinct vectors, so that no task holds all
sources or all vectors; a cell of vectors that touch neither block adds nothing beyond what every term without counts adds, which is known from the totals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MIN_DOCS, RANKS = 10, 10
SOURCES_PER_BLOCK = 256
ENTRIES_PER_CELL = 200_000
TERMS_PER_SALT = 10_000
#: Distinct terms that a task counts before it hands its counts on.
_HELD_TERMS = 200_000
_ROWS_AT_ONCE = 1 << 20  # entries of a dense part of a cell
#: A-Z lower-cased, other bytes below 0x80 that are no letters as spaces; UTF-8 needs no more, as no byte of another character lies below 0x80.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, source, term, n, docs) of rows (lang, source, text)."""

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            terms = list(times)
            for k in range(0, len(terms), 1 << 16):
                own = terms[k : k + (1 << 16)]
                columns = [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string())]
                columns += [pa.array([c[t] for t in own], pa.int64()) for c in (times, docs)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    held: dict = {}
    size = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source")), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(_TERMS).split()
            size -= len(times)
            times.update(words)
            docs.update(set(words))
            size += len(times)
            if size > _HELD_TERMS:
                yield from out(held)
                held, size = {}, 0
    yield from out(held)


def _share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * counts / total) for counts of at most total, by long division: nothing beyond 1000 * total has to fit a long."""
    rest, quotient = np.broadcast_arrays(counts, total)[0], 0
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // total, rest % total
    return 1 + quotient


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _best(value: np.ndarray, term: list[str], number: np.ndarray, ranks: int) -> list[tuple]:
    """The ranks vectors of the greatest value, equal ones by their first term: no other one can hold a term of these ranks."""
    if len(value) > ranks:
        take = np.flatnonzero(value >= np.partition(value, len(value) - ranks)[len(value) - ranks])
    else:
        take = np.arange(len(value))
    return sorted((-v, term[k], n) for v, k, n in zip(value[take].tolist(), take.tolist(), number[take].tolist(), strict=True))[:ranks]


def _cell(vectors: pa.Table, groups: pa.Table, ranks: int) -> pa.Table:
    """The share of a cell: of each pair of its two blocks the sum of f over the vectors, of each source the vectors that can hold its best terms."""
    lang, a, b, chunk = (groups.column(c)[0].as_py() for c in ("lang", "a", "b", "chunk"))
    rows: list[tuple] = []
    names, block = groups.column("source").to_pylist(), groups.column("block").to_numpy()
    kept_terms, lang_total = groups.column("terms")[0].as_py(), groups.column("lang_total")[0].as_py()
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    total = groups.column("total").to_numpy() + 2 * kept_terms
    others = {int(s): right[right > s] if a == b else right for s in left}
    sums = {s: np.zeros(len(o), np.int64) for s, o in others.items()}
    if kept_terms:
        none = _share(np.full(len(names), 2, np.int64), total)
        absent = {s: _apart(none[s], none[o]) for s, o in others.items()}
        if chunk == 0:
            sums = {s: kept_terms * absent[s] for s in sums}
        best: dict[int, list] = {s: [] for s in sums}
        if vectors.num_rows:
            vectors = vectors.combine_chunks()
            lists = vectors.column("vec").chunk(0)
            entries = lists.flatten()
            source = pc.index_in(entries.field("source"), value_set=pa.array(names)).to_numpy()
            n, owner = entries.field("n").to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            times, number, whole = (vectors.column(c).to_numpy() for c in ("times", "number", "n"))
            term = vectors.column("first_term").to_pylist()
            step = max(1, _ROWS_AT_ONCE // len(names))
            for k in range(0, len(lists), step):
                own = slice(*np.searchsorted(owner, [k, k + step]))
                counts = np.zeros((min(step, len(lists) - k), len(names)), np.int64)
                counts[owner[own] - k, source[own]] = n[own]
                p, m = _share(counts + 2, total), times[k : k + step]
                q = _share(whole[k : k + step] + 2, np.int64(lang_total + 2 * kept_terms))
                for s, o in others.items():
                    sums[s] = sums[s] + m @ (_apart(p[:, s, None], p[:, o]) - absent[s])
                    if a == b:
                        own_rows = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
                        got = _best(_apart(p[own_rows, s], q[own_rows]), [term[k + r] for r in own_rows], number[k + own_rows], ranks)
                        best[s] = sorted(best[s] + got)[:ranks]
        rows += [(lang, names[s], None, -v, t, i) for s, found in best.items() for v, t, i in found]
    for s, o in others.items():
        rows += [(lang, names[s], names[x], v, None, None) for x, v in zip(o.tolist(), sums[s].tolist(), strict=True)]
    kinds = {"lang": pa.string(), "source": pa.string(), "other": pa.string(), "value": pa.int64(), "first_term": pa.string(), "number": pa.int64()}
    return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})


def term_vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term and vec (source and count, by source) of each term that is in at least min_docs rows of its lang."""
    own = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = own.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return vectors.where(F.col("docs") >= min_docs).select("lang", "term", "vec")


def distinct_vectors(terms: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, vec, times (terms that have it), first (the least of them, ranks at most) and n (sum of its counts). Terms of one vector are spread over salts."""
    salts = 1 + terms.count() // TERMS_PER_SALT
    least = lambda c: F.slice(F.sort_array(c), 1, ranks).alias("first")
    some = terms.groupBy("lang", "vec", F.pmod(F.xxhash64("term"), F.lit(salts)).alias("salt")).agg(F.count("*").alias("times"), least(F.collect_list("term")))
    whole = some.groupBy("lang", "vec").agg(F.sum("times").alias("times"), least(F.flatten(F.collect_list("first"))))
    return whole.withColumn("n", F.aggregate("vec", F.lit(0).cast("long"), lambda s, e: s + e["n"])).withColumn("number", F.monotonically_increasing_id())


def group_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, total (counts of kept terms), terms (kept ones of the lang) and lang_total of each group of docs."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = terms.select("lang", F.explode("vec").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("total"))
    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(terms.groupBy("lang").agg(F.count("*").alias("terms")), "lang")
    found = groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    return found.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total")])


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value and rank of the groups of docs(lang, source, text): part `pair` ranks the other sources of the lang, part `term` terms.

    Terms, p and f are those of the contract; all numbers are exact integers as long as a lang has under 9 * 10^15 counted terms. Null langs, sources and texts
    are empty ones. Every row is a document, repeated ones too. Equal values go by the item's UTF-8 bytes. A lang without terms gives its pairs with value 0, a
    lang of one source no pair, and no documents no rows.
    """
    terms = written(term_vectors(docs, min_docs), "audit_terms")
    groups = written(group_totals(docs, terms), "audit_groups")
    vectors = written(distinct_vectors(terms, ranks), "audit_vectors")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    entries = vectors.agg(F.sum(F.size("vec"))).first()[0] or 0
    blocks, chunks = 1 + most // SOURCES_PER_BLOCK, 1 + entries // ENTRIES_PER_CELL

    block = lambda source: F.pmod(F.xxhash64(source), F.lit(blocks)).cast("int")
    every_block, cell = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), ["lang", "a", "b", "chunk"]
    touched = vectors.withColumn("blocks", F.array_distinct(F.transform("vec", lambda e: block(e["source"])))).withColumn("mine", F.explode("blocks")).withColumn("with", every_block)
    touched = touched.where(~(F.array_contains("blocks", F.col("with")) & (F.col("with") < F.col("mine")))).withColumn("a", F.least("mine", "with")).withColumn("b", F.greatest("mine", "with"))
    inside = F.filter("vec", lambda e: (block(e["source"]) == F.col("a")) | (block(e["source"]) == F.col("b")))
    sent = touched.select("lang", "a", "b", F.pmod(F.xxhash64("number"), F.lit(chunks)).alias("chunk"), inside.alias("vec"), "times", "n", "number", F.col("first")[0].alias("first_term"))
    asked = groups.withColumn("block", block(F.col("source"))).withColumn("with", every_block).withColumn("a", F.least("block", "with")).withColumn("b", F.greatest("block", "with"))
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    schema = "lang string, source string, other string, value long, first_term string, number long"
    cells = written(sent.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(lambda v, g: _cell(v, g, ranks), schema), "audit_cells")

    pairs = cells.where(F.col("other").isNotNull()).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("e"), "value").select("lang", "e.source", "e.item", "value")
    ranked = lambda rows, item: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)))
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    best = ranked(cells.where(F.col("other").isNull()), "first_term").where(F.col("rank") <= ranks).select("lang", "source", "value", "number")
    best = best.join(vectors.select("number", "first"), "number").select("lang", "source", F.explode("first").alias("item"), "value")
    return part(ranked(pairs, "item"), "pair").union(part(ranked(best, "item").where(F.col("rank") <= ranks), "term"))
