import random
from collections import Counter

import numpy as np
import pytest

from framelake.llm import components, jaccard_join, line_dedup, parts, substring

from . import brute


@pytest.mark.parametrize("window", [20, 7])
def test_substrings(spark, rows, docs, window):
    more = [(20_000, "p q r s t u v " * 9), (20_001, "a a a a a a a a a a a a a a a a a a a a a"), (20_002, "x y " * 30 + "p q r s t u v p q r s t u v p q r s t u v z"), (20_001, "y" + " b" * 50)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    all_rows = rows + more
    want = Counter((i, len(w), sum(g), " ".join(x for x, out in zip(w, g) if not out)) for (i, _), (w, g) in zip(all_rows, brute.substrings(all_rows, window)))
    assert Counter(map(tuple, substring.dedup_substrings(df, window).collect())) == want


def test_no_substrings(docs):
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def near_copies(seed, n=120):
    """Families of texts that differ by a few words, some near the threshold, over shared passages."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    out = []
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 80]))] + (passage if family % 2 else [])
        for _ in range(n // 6):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("long_list", [jaccard_join.LONG_LIST, 3])
def test_jaccard(spark, rows, docs, long_list):
    more = [(30_000 + k, t) for k, t in enumerate(near_copies(long_list))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string").repartition(3))
    got = Counter(map(tuple, jaccard_join.link(df, long_list=long_list).collect()))
    assert got == Counter(brute.jaccard(rows + more))


def test_jaccard_of_a_large_near_group(spark):
    """Most pairs lie just under the threshold, few above it; sets meet in many small blocks."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        t = list(base)
        for at in rng.sample(range(120), rng.choice([2, 3, 3, 4, 4, 5])):
            t[at] = rng.choice(["x", "y", f"z{k}"])
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block_bytes in (jaccard_join.SMALL_BLOCK, 20_000):
        got = sorted(map(tuple, jaccard_join.link(df, long_list=20, small_block=block_bytes).collect()))
        assert got == sorted(brute.jaccard(rows))


def test_spanning_links():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 300):
        a, b = rng.integers(0, 60, (2, n))
        some = jaccard_join._spanning(a, b)
        assert len(some) < 60

        def classes(places):
            of = {x: {x} for x in range(60)}
            for x, y in zip(a[places].tolist(), b[places].tolist()):
                both = of[x] | of[y]
                for z in both:
                    of[z] = both
            return {frozenset(x) for x in of.values()}

        assert classes(some) == classes(np.arange(n))


def test_jaccard_of_nothing(docs):
    assert jaccard_join.link(docs.limit(0)).count() == 0


def test_parts_grow_with_the_texts(spark, rows, docs, monkeypatch):
    """Parts of 4 KB and as many buckets as they ask for: the same answers; without rows, the least number."""
    assert parts.count(docs.limit(0)) == 4 * parts.PARTS_PER_TASK
    monkeypatch.setattr(parts, "PART_BYTES", 4096)
    n = parts.count(docs)
    assert n == -(-sum(len((t or "").encode()) for _, t in rows) // 4096) > 50 and parts.buckets(spark, n) == n // 4
    some = docs.where("doc_id < 60 OR doc_id >= 10000 OR doc_id IS NULL")
    own = [(r.doc_id, r.text) for r in some.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard_join.link(some).collect()), key=str) == sorted(brute.jaccard(own), key=str)
    got = Counter((r.doc_id, r.kept_text) for r in substring.dedup_substrings(some).collect())
    assert got == Counter((i, " ".join(w for w, g in zip(words, gone) if not g)) for (i, _), (words, gone) in zip(own, brute.substrings(own)))


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(500, 500), (7, 7), (300, 301), (301, 300)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
    assert got == {(x, find(x)) for x in parent if x not in alone}


def edited_lines(seed, edits):
    rng = random.Random(seed)
    letters = "abcdé ü"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(12, 40))) for _ in range(12)]
    out = []
    for _ in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, edits + 1)):
            at = rng.randrange(len(t))
            t[at : at + rng.choice([0, 1, 1])] = [rng.choice(letters)] * rng.choice([0, 1, 1])
        out.append("".join(t))
    return ["\n".join(rng.sample(out, 3)) for _ in range(60)]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines(spark, rows, docs, edits):
    more = [(40_000 + k, t) for k, t in enumerate(edited_lines(edits, edits))]
    some = rows[:60] + rows[-20:] + more
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in some], "doc_id long, text string, line string, mark int").repartition(3)
    got = line_dedup.dedup_lines(df, edits=edits, min_chars=10).drop("mark").collect()
    assert Counter(map(tuple, got)) == Counter(brute.lines(some, edits, 10))
    if edits == 1:
        gone = Counter(brute.lines(some, edits, 10))
        left = line_dedup.without_lines(df, edits=edits, min_chars=10).collect()
        assert len(left) == len(some) and left[0].asDict().keys() == {"doc_id", "text", "line", "mark"}
        texts = {(i, t): {int(x) for x in d.split(",") if x} for (i, t), (_, _, _, d) in zip(some, brute.lines(some, edits, 10))}
        want = Counter((i, t if not g else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)) for (i, t), g in ((key, texts[key]) for key in some))
        assert Counter((r.doc_id, r.text) for r in left) == want and sum(gone.values()) == len(some)


def test_lines_that_share_a_half(spark, monkeypatch):
    """A template with a free half: no pairs are made under its key, and the answer is that of pairs."""
    rng = random.Random(8)
    letters = "abcdefgh"
    rows = [(k, "posted by the same author on " + "".join(rng.choice(letters[:3]) for _ in range(rng.randint(28, 30)))) for k in range(300)]
    rows += [(1000 + k, t[:40] + rng.choice(letters) + t[40 + rng.randint(0, 1) :]) for k, (_, t) in enumerate(rng.sample(rows, 120))] + [(5000, rows[7][1]), (None, rows[9][1] + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = []
    write = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda d, name: made.append((name, write(d, name))) or made[-1][1])
    got = Counter(map(tuple, line_dedup.dedup_lines(df, 1, 40, crowded_key=20).drop("mark").collect()))
    assert got == Counter(brute.lines(rows, 1, 40)) and sum(n for _, _, n, _ in got) > 50
    assert dict(made)["line-pairs"].count() < 3 * len(rows)


def test_long_lines_that_share_a_half(spark):
    """600 lines of 6,000 characters with one half: every third is an edit away from the one before it. Patterns of a line take work in proportion to its length."""
    rng = random.Random(12)
    half = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows, want = [], set()
    for k in range(600):
        rest = "".join(rng.choice("abcdefgh ") for _ in range(2999)) + "."
        if k % 3 == 2:
            before = rows[-1][1][3000:]
            at = rng.randrange(10, 2900)
            rest = [before[:at] + "ü" + before[at:], before[:at] + "ü" + before[at + 1 :], before[:at] + before[at + 1 :]][k // 3 % 3]
            want.add(k)
        rows.append((k, half + rest))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in got if r.n_dropped} == want and all(r.n_lines == 1 for r in got)


def test_without_lines_keeps_columns_of_any_name(spark):
    line = "a line of more than forty characters, twice in the table"
    rows = [(1, line, "m", 7, line), (2, line, "n", 8, "x"), (None, line, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _mark string, line_nos int, `row.text` string")
    got = {r[0]: tuple(r) for r in line_dedup.without_lines(df).collect()}
    assert got == {1: rows[0], 2: (2, "", "n", 8, "x"), None: (None, "", None, None, None)} and line_dedup.without_lines(df).columns == df.columns


def test_lines_of_nothing(docs):
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_band(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abü") for _ in range(n))
    pairs = [(a, b) for _ in range(400) for a in [word(rng.randint(0, 14))] for b in [word(rng.randint(0, 14)) if rng.random() < 0.4 else a[: rng.randint(0, 14)] + word(rng.randint(0, 2)) + a[rng.randint(0, 14) :]]]
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 4):
        got = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
        assert all(r.w == (brute.edit_distance(r.a, r.b) <= edits) for r in got)


def test_lines_that_differ_in_a_word_and_short_repeats(spark, rows):
    rng = random.Random(9)
    vocabulary = ["alpha", "be", "gamma", "de", "epsilonic", "zeta", "eta", "thetatheta"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 12))) for _ in range(10)]
    out = []
    for _ in range(200):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1, 1])
        out.append((" " if rng.random() < 0.8 else "  ").join(w))
    some = rows[:40] + [(50_000 + k, "\n".join(rng.sample(out, 3) + ["", "MIT"])) for k in range(60)]
    want = Counter(brute.all_lines(some, 30, 0.25))
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(df, 1, 30, word_share=0.25, short_repeats=True).drop("mark").collect()
    assert Counter(map(tuple, got)) == want
    assert sum(n for _, _, n, _ in want) > 60 and Counter(map(tuple, line_dedup.dedup_lines(df, 1, 30).drop("mark").collect())) != want


def test_large_parts_are_hashed_piece_by_piece(spark, monkeypatch):
    """Words at the ends of pieces, texts of nothing but spaces, and words longer than a piece hash as in one piece; what a part holds is a few times its words, not fifty times its letters."""
    import tracemalloc

    from framelake.llm import shingles

    rng = random.Random(17)
    texts = ["".join(rng.choice("ab \n\t") for _ in range(rng.randrange(0, 40))).encode() for _ in range(200)] + [b"", b" ", b"x" * 9000 + b" y", b"z" * 5000]
    whole = shingles.word_hashes(texts)
    assert whole[1].tolist() == [len(t.split()) for t in texts]
    for size in (1, 7, 64, 4096):
        monkeypatch.setattr(shingles, "HASHED_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(shingles.word_hashes(texts), whole))
    monkeypatch.undo()
    assert [len(x) for x in shingles.word_hashes([])] == [0, 0]
    long = [b"words of some length " * 5000] * 80  # 8 MB
    tracemalloc.start()
    shingles.word_hashes(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    monkeypatch.setattr(parts, "PART_BYTES", 4096)
    docs = spark.createDataFrame([(k, "x" * 1000) for k in range(100)], "doc_id long, text string")
    assert parts.small(docs) == (98, 98) and parts.small(docs.limit(0)) == (16, 4)  # buckets keep to the bytes as well
