"""The divergence audit, the exact search and the filter interaction audit against plain-Python versions, and their SQL."""

import random

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import divergence, exact_search, filter_audit
from framelake.llm.oracle import ORACLE_SQL
from framelake.llm.queries import QUERIES
from tests import oracle

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_source_divergence_audit", "op12_exact_top_k_search", "op13_filter_interaction_audit"])
def test_equals_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF), oracle.connect(SF), ORACLE_SQL[name]) > 0


def corpus(rng, n, sources):
    words = ["the", "a", "Ärger", "été", "漢字", "x" * 300, *(f"w{chr(97 + k)}" for k in range(26)), *(f"rare{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(rng.choice(words[: rng.choice([6, 32, 52])]) for _ in range(rng.randrange(40))) + rng.choice(["", "\n", "1THE2tHe", "!"]), rng.choice(["en", "de", None]), rng.choice(sources)) for _ in range(n)]
    return rows + [(None, "en", sources[0]), ("", "fr", "alone"), ("few words", "fr", "other"), (None, "it", None), *[("the the", "en", sources[0])] * (n // 2)]


def check_sources(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    got = sorted(map(tuple, divergence.audit_sources(df, **how).collect()))
    assert got == sorted(brute.sources(rows, how.get("min_docs", 10), how.get("ranks", 10)))
    return got


def test_divergence(spark):
    """Nulls, empty and repeated rows, a hot source with half of all rows, langs without terms and with one source, clashing columns."""
    got = check_sources(spark, corpus(random.Random(1), 300, ["s0", "s1", "é", "", None, "S1"]))
    assert {r[2] for r in got if r[0] == "en"} == {"pair", "term"} and all(r[4] == 0 for r in got if r[0] == "fr")


def test_divergence_in_blocks(spark, monkeypatch):
    """Several blocks of sources, shares of vectors, salts and flushes give the same rows."""
    monkeypatch.setattr(divergence, "SOURCES_PER_BLOCK", 4)
    monkeypatch.setattr(divergence, "ENTRIES_PER_CELL", 30)
    monkeypatch.setattr(divergence, "TERMS_PER_SALT", 5)
    check_sources(spark, corpus(random.Random(2), 200, [f"s{k}" for k in range(11)]), min_docs=3, ranks=4)


def test_divergence_of_ties_and_nothing(spark):
    """Terms of one vector tie everywhere and go by their bytes; no rows give none."""
    rows = [(" ".join(["b", "a", "é", "B", "zz", "c", "d", "e", "f", "g", "h", "i", "j"]), "en", f"s{k % 2}") for k in range(24)] + [("a b é zz c d e f g h i j", "en", "s2")] * 3
    check_sources(spark, rows)
    assert divergence.audit_sources(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_divergence_counts_in_portions(monkeypatch):
    """What a task hands on early adds up, and 5 MB texts are counted whole."""
    monkeypatch.setattr(divergence, "_HELD_TERMS", 3)
    batch = pa.table({"lang": ["en"] * 3, "source": ["s"] * 3, "text": ["a b c d " * 600_000, "a A", "c"]}).to_batches()
    n, docs = {}, {}
    for b in divergence._counted(iter(batch)):
        for r in b.to_pylist():
            n[r["term"]] = n.get(r["term"], 0) + r["n"]
            docs[r["term"]] = docs.get(r["term"], 0) + r["docs"]
    assert n == {"a": 600_002, "b": 600_000, "c": 600_001, "d": 600_000} and docs == {"a": 2, "b": 1, "c": 2, "d": 1}


def test_shares_are_exact_beyond_long():
    """10^9 * count passes 2^63 here; long division does not."""
    counts, total = np.array([1, 10**12, 9 * 10**14, 9 * 10**15 - 1]), np.array([9 * 10**15] * 4)
    assert divergence._share(counts, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(counts, total, strict=True)]


def check_nearest(spark, rows, kind="float", **how):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], f"vec_id long, embedding array<{kind}>, number int").repartition(3)
    got = sorted(map(tuple, exact_search.top_vectors(df, **how).collect()), key=str)
    assert got == sorted(brute.nearest(rows, how.get("k", 5), how.get("every", 50)), key=str)
    return got


def test_search(spark):
    """Ties, copies, repeated and null ids, null, empty, sparse, short and non-finite vectors; blocks of three queries and four rows."""
    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for k in range(120)]
    rows += [(200 + k, [0.5] * 8) for k in range(40)] + [(50, [0.25] * 8), (50, [0.25] * 8), (None, [1.0] * 8), (300, [1.0] * 3), (350, []), (400, None), (450, [None] * 8), (500, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7), (600, [-0.001] * 9)]
    check_nearest(spark, rows)
    assert check_nearest(spark, rows, every=7, k=3, queries_per_block=3, rows_per_block=4)


def test_search_of_few(spark):
    assert check_nearest(spark, [(0, [1.0])]) == [] and check_nearest(spark, []) == [] and check_nearest(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert check_nearest(spark, [(0, [1.0, -1.0]), (1, [2.0, 0.5]), (-50, [0.0, 0.0])])


def test_search_of_wide_values(spark):
    """Sums beyond 32 and 64 bits."""
    rng = random.Random(4)
    check_nearest(spark, [(k, [rng.uniform(-1, 1) * 10**e for e in (0, 3, 6)]) for k in range(60)], "double")
    check_nearest(spark, [(k, [rng.uniform(-1, 1) * 10**e for e in (0, 9, 14)]) for k in range(60)] + [(100, [1e300, -1e300, 3.0])], "double")


def check_orders(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id long, text string, source string, fails int, first boolean").repartition(3)
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = sorted(map(tuple, filter_audit.audit_filters(df, known).collect()))
    assert got == sorted(brute.filter_orders(docs, labels))
    return got


def test_filter_orders(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["one", "two", f"n{rng.randrange(500)}", rng.choice(["#", "Upper", "UPPER", "é"])][: rng.choice([2, 3, 4])]) for _ in range(rng.choice([0, 10, 199, 200, 400]))) for _ in range(80)]
    texts += [" ".join(f"w{k}" for k in range(250))] * 5 + [" ".join(f"w{k % 100}" for k in range(200)), "É" * 98 + "AB", "É" * 97 + "ABC", "a\x1cb\x85c " * 200, "x" * 2_000_000]
    docs = [(rng.randrange(10**6), t, rng.choice(["s0", "s0", "s1", "", None])) for t in texts]
    docs += [(i + 1, t, "copies") for i, t, _ in docs[:10]] + docs[:3] + [(None, texts[0], "s0"), (None, None, None), (7, None, "nul"), (8, "", "nul"), (9, None, "nul")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _, _ in docs[:60] if i is not None] + [(docs[0][0], 1, 1), (None, 1, 1), (-5, 1, 1)]
    got = check_orders(spark, docs, labels)
    assert len(got) == 600 * len({r[0] for r in got}) and sum(r[8] for r in got) and sum(r[7] for r in got)


def test_filter_orders_without_rows(spark):
    assert check_orders(spark, [], [(1, 1, 1)]) == []
    assert len(check_orders(spark, [(1, "a b", "s")], [])) == 600


def test_set_counts_in_portions(monkeypatch):
    """Parts handed on early, and more rows than a word of a bitset has bits."""
    monkeypatch.setattr(filter_audit, "_HELD_PARTS", 1)
    rng = random.Random(6)
    rows = [(rng.choice("abc"), rng.randrange(32), rng.random() < 0.5, rng.random() < 0.1) for _ in range(1000)]
    t = pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate({"part": pa.string(), "fails": pa.int32(), "good": pa.bool_(), "toxic": pa.bool_()}.items())})
    got = {}
    for b in filter_audit.set_counts(iter(t.to_batches(max_chunksize=130))):
        for r in b.to_pylist():
            key = r["part"], r["subset"]
            got[key] = tuple(x + y for x, y in zip(got.get(key, (0, 0, 0)), (r["kept"], r["good"], r["toxic"]), strict=True))
    for (part, s), counts in got.items():
        own = [r for r in rows if r[0] == part and not r[1] & s]
        assert counts == (len(own), sum(r[2] for r in own), sum(r[3] for r in own))
