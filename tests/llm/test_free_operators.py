import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framelake.llm import html_extract, packing, quality

from . import brute

SF = "/root/testdata/sf0.001"


def page(main, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}{main}{after}</body></html>"


LONG = "This is a sentence, with some words in it; and it goes on, as prose does. "
PAGES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    (page("<article><h1>Title</h1><p>One &lt;b&gt; two.</p><p>  Three\n four<br>five </p></article>"), "Title\nOne <b> two.\nThree four five"),
    (page(f"<article><h1>T&eacute;</h1><p>{LONG}<p>Short.</article>", "<nav><ul><li><a href=x>Home<li>About</ul></nav><div class='ad'>Buy, now.</div>", "<footer>&copy; me"), f"Té\n{LONG.strip()}\nShort."),
    (page(f"<div id=content><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>End.</p></div>", "<div class='top-menu'>A B C</div><header><p>Site</p></header>", "<div class='comments'><p>I say, this is good. Really, it is.</p></div><aside>More</aside>"), "\n".join(["Head", LONG.strip(), LONG.strip(), "End."])),
    (page(f"<main><p>{LONG}</p><div class='cookie-notice'>We use cookies.</div><form><p>Name<input></p></form><ul><li>a, b</li><li>c</li></ul><p>x<script>var a='<p>no</p>';</script>y</p></main>"), f"{LONG.strip()}\na, b\nc\nxy"),
    (page(f"<article><p><b>Bold {LONG}<br><p>Next</p><section id=\"comments\"><article><p>{LONG * 3}</p></article></section></article>"), f"Bold {LONG.strip()}\nNext"),
    ("<div><p>unclosed <b>tags <i>everywhere", "unclosed tags everywhere"),
    ("<a href=\"x>y\">q</a> <p title='a>b'>z", "q\nz"),
    ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
    ("<script>never closed", ""),
    ("<" * 5000 + "p", "<" * 4999),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    "inner,text",
    [
        ("<p>See <a href='/hidden-beaches'>the beaches</a> and <a href='/view?id=legal' data-id='legal'>this</a>.</p>", "See the beaches and this."),
        ('<p title="a hidden gem">Gem.</p><p hidden>no</p><p aria-hidden="true">no</p><p style="display: none">no</p>', "Gem."),
        (f"<section id='discussion'><p>{LONG}</p></section>", LONG.strip()),
        ("<h2 id='side-effects'>Side effects</h2><div class='entry-header'><h1>Title</h1></div>", "Side effects\nTitle"),
        ("<div class='share'><p>Tweet</p></div><div class='related'><ul><li>More</li></ul></div><div class='sidebar'><p>no</p></div>", ""),
    ],
)
def test_names_and_values_inside_articles(inner, text):
    assert html_extract.main_text(page(f"<article><p>{LONG}</p>{inner}<p>{LONG}</p></article>")) == "\n".join(x for x in [LONG.strip(), text, LONG.strip()] if x)


PROSE = f"<h2>Heading</h2><p>{LONG}</p>"


@pytest.mark.parametrize("start", ['div class="cookie-recipe"', 'section id="widget-api"', 'section id="promotion"', 'section id="modal-verbs"', 'section id="login"', 'div class="comments-in-code"', 'section id="related"'])
def test_names_of_parts_of_an_article_keep_their_prose(start):
    """Words that boilerplate uses too; the part stays whole, heading and all. The same names around a few links go."""
    tag = start.split()[0]
    inside = lambda x: html_extract.main_text(page(f"<article><p>{LONG}</p><{start}>{x}</{tag}><p>{LONG}</p></article>"))
    assert inside(PROSE) == "\n".join([LONG.strip(), "Heading", LONG.strip(), LONG.strip()])
    assert inside("<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>") == "\n".join([LONG.strip()] * 2)


@pytest.mark.parametrize("start", ['div class="wp-comments-area"', 'section id="comments"', 'div class="ad-300"', 'div class="cookie-notice box"', 'div class="post-newsletter"'])
def test_names_that_say_nothing_else_go(start):
    assert html_extract.main_text(page(f"<article><p>{LONG}</p><{start}>{PROSE}</{start.split()[0]}></article>")) == LONG.strip()


def test_share_decides_about_unsure_parts():
    """A part of an unsure name and middling length stays or goes by the threshold alone."""
    part = f"<article><p>{LONG * 3}</p><section id='promotion'><p>{LONG}</p></section><p>{LONG * 3}</p></article>"
    text = {share: html_extract.main_text(page(part), radius=0, share=share).count("\n") for share in (0.05, 0.3)}
    assert text == {0.05: 2, 0.3: 1}


def test_math_media_and_siblings():
    assert html_extract.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be a number.</p></article>") == "Let x=1 be a number."
    assert html_extract.main_text("<article><p>See <video src=x>the film</video> or <object data=y>the picture</object>.</p></article>") == "See the film or the picture."
    two = [LONG.strip() + " one", LONG.strip() + " two"]
    assert html_extract.main_text("".join(f"<article><p>{t}</p></article><div>x</div>" for t in two)) == "\n".join(two)
    assert html_extract.main_text(f"<article><p>{LONG * 9}</p></article><article><p>Short teaser.</p></article>") == (LONG * 9).strip()


def test_pages_without_articles_lose_link_paths():
    assert html_extract.main_text(f"<div><p>{LONG}</p><div class=x><a>Buy now</a></div><h3>Next</h3><p>{LONG}</p></div>") == "\n".join([LONG.strip(), "Next", LONG.strip()])
    assert html_extract.main_text("<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>") == "One\nTwo"


def test_content_paths_by_definition():
    """Ratios, smoothing, fusion and threshold against a plain version, over the test pages and the pages of the table."""
    from pyarrow import dataset

    real = dataset.dataset(f"{SF}/pages.parquet").to_table(columns=["html"]).column("html").to_pylist()
    for html_page in [h for h, _ in PAGES] + real + [page(f"<article><p>{LONG}</p><section id='promotion'>{PROSE}<ul><li>a<li>b</ul></section><p>x.</article>")]:
        found = html_extract.blocks(html_page or "")
        if found:
            for radius, share in ((1, 0.3), (0, 0.9), (3, 1.5)):
                want = brute.content_paths([(at.path, bool(at.unsure), text) for at, text, _ in found], radius, share, html_extract.LOWERED)
                assert html_extract.content_paths(found, radius, share) == want


def test_extract_pages(spark):
    rows = [(k, f"u{k}", h, "x") for k, (h, _) in enumerate(PAGES)] + [(0, "u0", None, "x"), (None, None, "<p>a</p>", "x")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(k, f"u{k}", t, len(t)) for k, (_, t) in enumerate(PAGES)] + [(0, "u0", "", 0), (None, None, "a", 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_keep_their_articles(spark):
    """The articles of the test pages are what stands in the article element."""
    import html as h
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r.html or "", re.S)
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", article[1]) if article else []
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert html_extract.main_text(r.html) == "\n".join(p for p in parts if p)


def test_quality(spark, rows, docs):
    got = quality.judge(quality.measure(docs)).collect()
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    want = [(i, *brute.quality(t)) for i, t in rows]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(quality.measure(docs.limit(0))).count() == 0


def test_fertility_by_hand(rows):
    """Counts of pieces, fallback bytes and entropy, against a plain loop over whole texts' words."""
    import pyarrow as pa

    paths = quality._default_paths()
    cuts = quality._Cuts(*paths)
    texts = [t or "" for _, t in rows][:40] + ["漢字 かな текст 🎉🎉 abc", "日本語 の 文章", "Привет мир"]
    got = quality._measured(pa.array(range(len(texts))), texts, cuts).to_pylist()
    for t, g in zip(texts, got, strict=True):
        tokens = [p for w in brute.WORD.findall(t) for p in cuts.piece.encode(w)]
        n, c = len(tokens), Counter(tokens)
        entropy = -sum(x / n * np.log2(x / n) for x in c.values()) if n else 0
        assert g["n_tokens"] == n and abs(g["entropy"] - entropy) < 1e-9
        assert abs(g["byte_share"] - (sum(cuts.piece.is_byte(x) for x in tokens) / n if n else 0)) < 1e-12
    assert [g["script"] for g in got[-3:]] == ["han", "han", "cyrillic"] and got[-3]["byte_share"] > 0


def test_quality_keeps_clean_and_rejects_noise(spark):
    real = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1]
    clean = [(i, real[i]) for i in good if not brute.quality(real[i])[-1]]
    noise = [(-1, " ".join("\U0001f9ff\U0001fac0"[k % 2] * (k % 7 + 1) for k in range(300))), (-2, " ".join(f"{'z' * (k % 5 + 60)}" for k in range(60)))]
    got = {r.doc_id: r.kept for r in quality.judge(quality.measure(spark.createDataFrame(clean + noise, "doc_id long, text string"))).collect()}
    assert all(got[i] for i, _ in clean) and not got[-1] and not got[-2]


def test_quality_keeps_a_short_text_with_keys():
    """Two long keys in 64 words do not decide; words that are all long do."""
    import pyarrow as pa

    keys = ["9f3b7c1d5e8a2046b1c9d7e3f5a80264", "0c4e8a6f2b7d9135e7a1c3f9b5d80642"]
    prose = ("the man went to the house and said that he would come back in the morning with a horse " * 4).split()[:62]
    texts = [" ".join(prose[:30] + [k * 3 for k in keys] + prose[30:]), " ".join(["z" * 60] * 64)]
    got = quality._measured(pa.array([0, 1]), texts, quality._Cuts(*quality._default_paths())).to_pylist()
    most = quality.BANDS["latin"]["fertility"][1]
    assert got[0]["n_tokens"] / got[0]["n_words"] > most >= got[0]["fertility"] and got[1]["fertility"] > most


def test_packing(spark, rows, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    total = 0
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[(i, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
            total += len(part)
    got = packing.pack(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_crossover_keeps_all_documents():
    rng = random.Random(5)
    counts = Counter(rng.choice([3, 40, 700, 1000, 1024, 1500, 2048]) + rng.randrange(1) for _ in range(500))
    parents = packing._evolve(counts, [], 2048, 1, 6, 4)
    for _ in range(20):
        child = packing._crossover(*rng.sample(parents, 2), counts, 2048, rng)
        used = Counter()
        for pattern, n in child.items():
            assert sum(pattern) <= 2048 and n > 0
            for s in pattern:
                used[s] += n
        assert used == counts


def test_crossover_beats_best_fit():
    """Triples that fill bins exactly: greedy best fit leaves gaps, crossovers of whole full bins close them."""
    rng = random.Random(11)
    counts = Counter()
    for _ in range(150):
        a = rng.randrange(500, 900)
        b = rng.randrange(500, 2048 - a - 400)
        counts.update([a, b, 2048 - a - b])
    greedy, left = Counter(), Counter(counts)
    packing._best_fit(left, greedy, 2048)
    calls = []
    crossover = packing._crossover
    packing._crossover = lambda *a: calls.append(1) or crossover(*a)
    try:
        first = packing._evolve(counts, [], 2048, 1, 0, 6)
        best = packing._evolve(counts, list(first), 2048, 1, 150, 6)
    finally:
        packing._crossover = crossover
    assert calls and packing._bins(best[0]) < packing._bins(greedy) and packing._fitness(best[0], 2048) < packing._fitness(first[0], 2048)


def test_plain_chunks_are_cut_as_by_the_library():
    import random

    tokens = packing._Tokens(public_tokenizers.path("word_bpe_49k.json"))
    rng, letters = random.Random(3), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLéèßüñçÉÖĐłŁ'0123456789.,!?%$*-_  \x01\x1c\x85\xa0ć²ª<|>́İΣ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|>x a<|startoftext|>b", "It's we'll 'S 'Re"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokens.library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.of(texts) == want


def test_deeply_nested_pages():
    """Work grows with a page's size, not with its depth: tags without end, ends without a start, and a text at the bottom."""
    began = time.perf_counter()
    assert html_extract.main_text("<div>" * 100_000 + "Some text, at last." + "</div>" * 100_000) == "Some text, at last."
    assert html_extract.main_text("<div>t" * 20_000 + "<li>a</b></q></td>" * 20_000).count("\n") == 39_999
    assert html_extract.main_text("<article>" + "<p>Some words, here. " * 200_000).count("\n") == 199_999
    assert time.perf_counter() - began < 60
