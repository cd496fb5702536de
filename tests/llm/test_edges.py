"""Very long texts, empty tables, null ids and clashing names, for every operator and every stage of the pipeline."""

import pytest

import corpus_pipeline
from framelake.llm import decontam, divergence, filter_audit, jaccard_join, licenses, line_dedup, packing, quality, secrets, substring

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: 5 MB: many short words, with a secret, a notice and a benchmark-like passage at the very end; and one line without a space.
LONG = [" ".join(f"w{k % 5000}" for k in range(800_000)) + "\npassword=abcdefgh12 released under the mit license", "\n".join(f"line {k} of the long text, with some more words in it" for k in range(100_000)), "ab" * 2_500_000]

OPERATORS = {
    "packing": lambda s, d: packing.pack(d),
    "quality": lambda s, d: quality.judge(quality.measure(d)),
    "jaccard": lambda s, d: jaccard_join.link(d),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "licenses": lambda s, d: licenses.scan_licenses(d, windows=True),
    "substring": lambda s, d: substring.dedup_substrings(d),
    "decontam": lambda s, d: decontam.report(decontam.with_hits(d, s.createDataFrame([(1, "w4990 w4991 w4992 w4993 w4994 w4995 w4996 w4997 w4998 w4999")], "item_id long, text string"))),
    "divergence": lambda s, d: divergence.audit_sources(d, min_docs=2),
    "filters": lambda s, d: filter_audit.audit_filters(d, s.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")),
}


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame([(k, t, "en", f"s{k}", len(t or "")) for k, t in enumerate([*LONG, "a short one", None])], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("name", [*OPERATORS])
def test_long_texts(spark, long_docs, name):
    got = OPERATORS[name](spark, long_docs).collect()
    by_id = {r.doc_id: r for r in got} if "doc_id" in got[0] else {}
    words = LONG[0].split()
    if name == "packing":
        assert {r.doc_id for r in got} == {0, 1, 2, 3, 4} and max(r.length for r in got) <= 2048
        for i in (0, 1, 2):
            own = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == i)
            assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))
    elif name == "quality":
        assert [(by_id[i].n_words, by_id[i].word_chars) for i in (0, 2)] == [(len(LONG[0].split()), len("".join(LONG[0].split()))), (1, 5_000_000)]
    elif name == "jaccard":
        assert {i: (by_id[i].n_shingles, by_id[i].component_id) for i in (0, 2, 4)} == {0: (len({*zip(*(words[k:] for k in range(5)))}), 0), 2: (1, 2), 4: (0, 4)}
    elif name == "secrets":
        assert by_id[0].n_assign == 1 and by_id[2].spans == "hex:0:5000000"
    elif name == "licenses":
        assert by_id[0].labels == "mit" and by_id[0].n_words == len(brute.ALNUM.findall(LONG[0])) and by_id[2].n_words == 1
    elif name == "substring":
        assert by_id[0].n_removed > 790_000 and by_id[2].kept_text == LONG[2]
    elif name == "decontam":
        assert (by_id[0].n_hit, by_id[0].n_items, by_id[1].n_hit) == (1600, 1, 0)
    elif name == "filters":
        assert len(got) == 600 * 5


def test_long_lines(spark, long_docs):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(long_docs.where("doc_id <> 1"), word_share=line_dedup.WORD_SHARE, short_repeats=True).collect()}
    assert (got[0].n_lines, got[2].n_lines, got[4].n_lines) == (2, 1, 0) and all(r.n_dropped == 0 for r in got.values())


@pytest.mark.parametrize("name", [*OPERATORS])
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_stand_anything(spark, stage):
    """No rows; null ids, texts and sources; repeated rows; columns whose names the stages use themselves."""
    name, function = stage
    assert function(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0
    prose = " ".join("the man went to the house and said that he would come back in the morning with a horse and one of his dogs because it was getting late and there was more to do than anyone had thought before they all set out from the town by the sea where ships come in every day of the year but one".split()) + ". " + "It was late."
    rows = [(1, prose), (None, prose + " More."), (2, None), (3, ""), (1, prose), (4, prose.replace("horse", "house"))]
    more = ["row", "words", "hits", "mark", "line_nos", "part", "node", "kept", "_mark"]
    df = spark.createDataFrame([(i, t, None, "s", len(t or ""), *range(len(more))) for i, t in rows], SCHEMA + "".join(f", `{c}` int" for c in more))
    out = function(spark, df, SF)
    got = out.collect()
    if name == "best_fit_packing":
        assert sorted({(r.doc_id is None, r.doc_id or 0) for r in got}) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    else:
        assert out.columns == df.columns and all(tuple(r)[5:] == tuple(range(len(more))) for r in got)
        assert {r.doc_id for r in got} <= {1, 2, 3, 4, None} and len(got) >= 1
