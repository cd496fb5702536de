import pytest

from framelake.llm import decontam, licenses, queries, secrets, url_rules

from . import brute

SF = "/root/testdata/sf0.001"


def same(rows, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(rows, key=key) == sorted(expected, key=key)


def test_url_rules(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "http://COM/en/x", "http://a.b.com/en/", "http://example.com/en/7", "http://xexample.com/en/7", "https://example.net/de/8?x", "http://net?/de/", "a://b.example.net/de/81#f", "x://y://org/es/", "http://www.example.org/ES/", "http://..com/en/"]
    got = url_rules.judge_urls(spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string"), spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string"), salts=3)
    same([tuple(r) for r in got.collect()], [(k, *brute.url(u, queries.URL_RULES)) for k, u in enumerate(urls)])


def test_url_rules_nested_and_empty(spark):
    rules = [("com", "", "block"), ("example.com", "", "allow"), ("a.example.com", "/p", "block"), ("b.example.com", "", "block"), ("example.com", "/p/q/r/long", "allow")]
    urls = ["h://com/", "h://x.com/", "h://example.com/", "h://z.example.com/p", "h://a.example.com/p", "h://a.example.com/q", "h://c.b.example.com", "h://a.example.com/p/q/r/long", "h://org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    schema = "host string, path string, verdict string"
    got = url_rules.judge_urls(pages, spark.createDataFrame(rules, schema))
    same([tuple(r) for r in got.collect()], [(k, *brute.url(u, rules)) for k, u in enumerate(urls)])
    none = url_rules.judge_urls(pages, spark.createDataFrame([("", "/x", "block"), (None, None, "block")], schema), default="block")
    assert {r.verdict for r in none.collect()} == {"block"}
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(rules, schema)).count() == 0


@pytest.mark.parametrize("max_set, max_broadcast", [(decontam.MAX_SET, decontam.MAX_BROADCAST), (3, decontam.MAX_BROADCAST), (3, 3)])
def test_decontamination(spark, rows, docs, max_set, max_broadcast):
    df = docs
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(901, "One"), (902, "e f g"), (903, None), (904, "..."), (905, "a b c d e f g h i j")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = brute.benchmark_windows(items)
    got = decontam.report(decontam.with_hits(df, bench, max_set=max_set, max_broadcast=max_broadcast))
    same([tuple(r) for r in got.collect()], [(i, *brute.leaks(t, windows)) for i, t in rows])
    if max_broadcast > 3:
        kept = {r.doc_id: r.text for r in decontam.decontaminate(df, bench, max_set=max_set).collect()}
        for i, t in rows:
            if brute.leaks(t, windows)[4]:
                assert i not in kept or brute.leaks(kept[i], windows)[1] < brute.leaks(t, windows)[1]
            else:
                assert kept[i] == t


def test_a_large_benchmark_is_broadcast(spark):
    """200,000 windows, and an item without an id."""
    bench = spark.range(20_000).selectExpr("if(id = 7, null, id) as item_id", "concat_ws(' ', transform(sequence(0, 18), k -> concat('w', id, 'x', k))) as text")
    text = " ".join(f"w7x{k}" for k in range(3, 14)) + " and " + " ".join(f"w9x{k}" for k in range(9)) + " or " + " ".join(f"W15X{k}" for k in range(10))
    df = spark.createDataFrame([(1, text), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    found = decontam.with_hits(df, bench)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.report(found).collect()}
    assert got == {1: (32, 21, 1, True), 2: (3, 0, 0, False), 3: (0, 0, 0, False)}


def test_decontamination_of_nothing(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.report(decontam.with_hits(docs, empty)).collect())
    assert decontam.report(decontam.with_hits(docs.limit(0), empty)).count() == 0


def test_secrets(rows, docs):
    df = docs
    got = secrets.scan_secrets(df).collect()
    same([tuple(r)[:5] for r in got], [(i, *brute.secrets(t)[0]) for i, t in rows])
    by_id = {r.doc_id: r.spans for r in got}
    for i, t in rows:
        base = [f"{s[2]}:{s[0]}:{s[3]}" for s in brute.secrets(t)[1]]
        assert set(base) <= set(by_id[i].split(",")) or not base


def test_many_secrets_in_one_text(spark):
    text = "".join(f"a{k} token=abcdefgh{k} é\n" for k in range(3000))
    got = secrets.scan_secrets(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).where("doc_id = 1").first()
    assert tuple(got)[:5] == (1, *brute.secrets(text)[0]) and got.n_assign == 3000


def test_entropy_spans(spark):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ81kTn"
    texts = [f"key {key} end", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1", "keitlichenlichkeitberheitlicherheit", f"example{key}", "A" * 24 + "9F3b", "12345678-1234-1234-1234-123456789abc"]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {0: f"entropy_base64:4:{4 + len(key)}", 1: "", 2: "", 3: "", 4: "", 5: ""}


def test_licenses(rows, docs):
    df = docs
    got = licenses.scan_licenses(df).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], [(i, *brute.licenses(t)) for i, t in rows])
    for r in got:
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert {r.labels for r in got if r.doc_id == 10_011} == {"cc-by-nc,mit"}


def test_license_join_is_exact(rows, docs):
    """The filters lose no block that reaches the threshold."""
    templates = {"the of and a": "x", "en de la que en el": "y", "released under the mit license": "mit"}
    df = docs
    for threshold in (0.5, 0.8, 1.0):
        got = {(r.doc_id, r.labels, round(r.score, 6)) for r in licenses.scan_licenses(df, phrases={"zzz": "z"}, templates=templates, threshold=threshold).collect()}
        want = set()
        for i, t in rows:
            share = {}
            for line in (t or "").split("\n"):
                have = set(brute.ALNUM.findall(brute.lower(line)))
                for k, label in templates.items():
                    own = set(k.split())
                    c = len(own & have) / len(own)
                    if c >= threshold - 1e-12:
                        share[label] = max(share.get(label, 0), c)
            want.add((i, ",".join(sorted(share)), round(max(share.values(), default=0.0), 6)))
        assert got == want


def test_license_windows(spark):
    """Notices over line breaks, and names that tell licenses apart."""
    cases = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software)": "mit",
        "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:": "bsd",
        "Released under the Foo License.": "",
        "Released under the BSD License.": "",
        "Released under the MIT\nLicense.": "mit",
        "Licensed under CC BY 4.0; figures by NC Press, version 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under CC BY-NC 4.0. Text licensed under CC BY 4.0.": "cc-by,cc-by-nc",
        "released yesterday " + "x " * 40 + "under the tree a license": "",
        "": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df, phrases={"zzz": "z"}, windows=True).collect()}
    assert [got[k].nearest for k in range(len(cases))] == list(cases.values())
    assert got[2].labels == got[3].labels == "mit" and got[2].score == 0.8  # four of the five tokens: at the threshold, whatever the name


#: Each holds all tokens of its template, among words that name other licenses.
NAMED = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software (SA) and associated documentation files",
    "Licensed under the Creative Commons (CC) Attribution NonCommercial 4.0 International License",
    "This source code form, unlike GNU code, is subject to the terms of the Mozilla Public License",
    "All rights reserved. No part of this MIT Press publication may be reproduced",
    "This work is licensed under the GNU GPL (General Public License) version 3",
]


def test_license_windows_are_exact(spark, rows):
    """Every template that some window contains to the threshold is labelled, with the templates and texts of the query, against all windows of each text."""
    templates = licenses.TEMPLATES | licenses.whole_texts()
    texts = [t for _, t in rows] + NAMED + [f"{a}\n{b}" for a, b in zip(NAMED, NAMED[1:])] + [t.upper() for t in templates] + [" ".join(t.split()[::-1]) for t in templates]
    texts += [" ".join(w for k, w in enumerate(t.split()) if k % 6) for t in templates] + [" x ".join(t.split()) for t in templates] + ["of the " * 2000 + NAMED[0] + " of the" * 2000]
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), phrases={"zzz": "z"}, templates=templates, windows=True).collect()}
    assert [got[k] for k in range(len(texts))] == [brute.license_windows(t, templates, licenses.THRESHOLD) for t in texts]
    five = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string"), windows=True).collect()}
    assert [label in five[k].split(",") for k, label in enumerate(["mit", "cc-by-nc", "mpl", "proprietary", "gpl"])] == [True] * 5


def test_licenses_without_rows_and_with_many_templates(spark, docs):
    """An empty table; more template tokens than the driver would want to plan one by one; a text of 5 MB."""
    assert licenses.scan_licenses(docs.limit(0), windows=True).count() == 0
    many = {" ".join(f"w{k}x{j}" for j in range(12)): f"l{k}" for k in range(600)}
    df = spark.createDataFrame([(1, "a w7x0 w7x1 w7x2 w7x3 w7x4 w7x5 w7x6 w7x7 w7x8 w7x9"), (2, "word " * 1_000_000 + "released under the mit license"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.n_words) for r in licenses.scan_licenses(df, templates=many | licenses.TEMPLATES, windows=True).collect()}
    assert got == {1: ("l7", 11), 2: ("mit", 1_000_005), 3: ("", 0)}
