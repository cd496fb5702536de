"""License scans: an exact set-similarity join of text blocks with license templates, and the license phrases of the contract.

Blocks are the lines of a text or, with `windows`, at each place the run of as many words as the template has, over line breaks. A template matches a block that holds at least `threshold` of the template's distinct tokens. The join is exact: tokens have
one global order, rarest in the corpus first; a block that reaches the threshold must hold one of a template's first `n - ceil(threshold * n) + 1` tokens (prefix
filter), must have enough distinct tokens (length filter), and from the place of its first matching token on there must be enough left (positional filter).
Templates are parameters of the query and live in the plan, for windows as one table of constants that a single expression reads; the corpus is read twice and never
shuffled, except for the counts of the templates' tokens.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_WORD, UPPER, alnum_words, ascii_lower, let

#: Phrases whose places are counted, and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices, and the labels that a block near one of them adds.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under the creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
}
THRESHOLD = 0.8
#: Words that tell licenses apart. A window that holds all that its template has, and its share of tokens before any other, makes the template a `nearest` one.
NAMES = frozenset("mit apache bsd gnu gpl lesser lgpl affero agpl mozilla mpl cc nc noncommercial sa sharealike nd noderivatives noderivs".split())


def whole_texts() -> dict[str, str]:
    """The license texts of license_texts.txt and their labels."""
    parts = [p.partition("\n") for p in Path(__file__).with_name("license_texts.txt").read_text().split("== ")[1:]]
    return {" ".join(re.findall("[a-z0-9]+", text.lower())): label for label, _, text in parts}


def _token_counts(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many words of the corpus are each of these tokens; no more rows come to the driver than it has tokens of templates."""
    words = docs.select(F.explode(F.filter(alnum_words(ascii_lower(F.col("text"))), lambda w: w.isin(tokens))).alias("token"))
    return dict(words.groupBy("token").count().collect())


def _phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    places = F.sequence(F.lit(0), F.size(words) - len(parts))

    def stands(i: Column) -> Column:
        found = F.lit(True)
        for k, part in enumerate(parts):
            found = found & (F.get(words, i + k) == part)
        return found

    return F.when(F.size(words) >= len(parts), F.filter(places, stands)).otherwise(F.array().cast("array<int>"))


_FOUND = "array<struct<label:string,share:double,nearest:boolean>>"


def _in_windows(text_words: Column, ordered: Mapping[str, list[str]], prefix: Mapping[str, list[str]], need: Mapping[str, int], labels: Mapping[str, str]) -> Column:
    """(label, share, nearest) of each template that reaches the threshold in a window of the words: share is its largest in any, nearest whether one with its names does."""
    rows = [
        {"own": ordered[t], "prefix": prefix[t], "names": sorted(NAMES & {*ordered[t]}), "others": sorted(NAMES - {*ordered[t]}), "need": need[t], "length": len(t.split()), "label": labels[t]}
        for t in ordered
    ]
    strings = "array<string>"
    templates = F.from_json(F.lit(json.dumps(rows)), f"array<struct<own:{strings},prefix:{strings},names:{strings},others:{strings},need:int,length:int,label:string>>")
    first_tokens = sorted({w for p in prefix.values() for w in p})

    def counts(t: Column, window: Column) -> Column:
        """Of the template's tokens, how many the window has, and how many before any other name, where it has all of the template's names there."""
        stop = F.array_min(F.transform(F.array_intersect(window, t["others"]), lambda x: F.array_position(window, x)))  # from 1
        before = lambda run: F.when(F.size(F.array_intersect(t["names"], run)) == F.size(t["names"]), F.size(F.array_intersect(t["own"], run))).otherwise(0)
        named = let(F.slice(window, F.lit(1), F.coalesce(stop.cast("int") - 1, F.size(window))), before)
        return F.struct(F.size(F.array_intersect(t["own"], window)).alias("n"), named.alias("named"))

    def judged(t: Column, words: Column) -> Column:
        # Prefix filter: a window that reaches the threshold holds one of the template's first tokens. Length filter: enough words must follow its begin.
        hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(t["prefix"], F.get(words, i)))
        near = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(F.greatest(p - t["length"] + 1, F.lit(0)), p))))
        begins = F.filter(near, lambda i: (F.size(words) - i >= t["need"]) & F.array_contains(t["own"], F.get(words, i)))
        found = F.transform(begins, lambda i: let(F.slice(words, i + 1, t["length"]), lambda window: counts(t, window)))
        most = let(found, lambda x: F.struct(F.array_max(F.transform(x, lambda c: c["n"])).alias("n"), F.array_max(F.transform(x, lambda c: c["named"])).alias("named")))
        return let(most, lambda m: F.when(m["n"] >= t["need"], F.struct(t["label"].alias("label"), (m["n"] / F.size(t["own"]).cast("double")).alias("share"), (m["named"] >= t["need"]).alias("nearest"))))

    def of(words: Column) -> Column:
        firsts = F.array_distinct(F.filter(words, lambda w: w.isin(first_tokens)))
        able = let(firsts, lambda f: F.filter(templates, lambda t: F.arrays_overlap(t["prefix"], f)))
        return F.array_compact(F.transform(able, lambda t: judged(t, words)))

    none = F.array().cast(_FOUND)
    return let(text_words, lambda w: F.when(F.size(w) > 0, of(w)).otherwise(none)) if ordered else none


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and nearest of each row of docs(doc_id, text).

    n_base: all places where a phrase's words stand in a row; first_word and last_word are null without any. labels: those of the phrases found, and of all templates
    that reach the threshold: with windows, in some run of at most as many words as the template has, over line breaks too; else in a line, where of templates that
    one another's text would match only the nearest counts (most of its tokens, then the shorter; equally near ones all). nearest: those of the phrases, and of the
    templates that reach the threshold in a window that holds all their names (NAMES), before any other name; without windows the same as labels. All label columns
    are distinct, sorted and joined by commas. score: the largest containment of a template that reaches the threshold, 1 if a phrase stands in the text, else 0.
    Null and empty texts: no words, no labels, score 0. Rows that repeat are judged one by one; templates without words are ignored.
    """
    sets = {t: sorted(set(t.split())) for t in templates if t.split()}
    tokens = sorted({w for s in sets.values() for w in s})
    counts = _token_counts(docs, tokens) if tokens else {}
    order = sorted(tokens, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    ordered = {t: sorted(s, key=rank.get) for t, s in sets.items()}
    need = {t: math.ceil(threshold * len(s) - 1e-9) for t, s in sets.items()}
    prefix = {t: s[: len(s) - need[t] + 1] for t, s in ordered.items()}
    first_tokens = sorted({w for p in prefix.values() for w in p})
    # Templates of another label so alike that the text of one would match the other: a block's label is then that of the nearer one.
    rivals = {t: [u for u in sets if templates[u] != templates[t] and len({*sets[t]} & {*sets[u]}) >= min(need[t], need[u])] for t in sets}

    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"), alnum_words(text).alias("raw")).select("doc_id", "text", F.size("raw").cast("long").alias("n_words"), "raw")
    # Case is folded for the few texts that can matter; folding all of Unicode finds no fewer of them.
    last_words = sorted({p.split()[-1] for p in phrases})
    maybe_phrase = F.lower("text").rlike("|".join(last_words)) if last_words else F.lit(False)
    words = F.when(maybe_phrase, F.split(F.translate(F.array_join("raw", " "), UPPER, LOWER), " ")).otherwise(F.array().cast("array<string>"))
    base = base.withColumn("words", words)
    for k, phrase in enumerate(phrases):
        base = base.withColumn(f"at_{k}", _phrase_starts(F.col("words"), phrase))
    places = F.concat(*[F.col(f"at_{k}") for k in range(len(phrases))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))

    maybe_block = F.lit(False)
    if first_tokens:
        maybe_block = F.lower("text").rlike(rf"(?:^|{NON_WORD})(?:{'|'.join(first_tokens)})(?:$|{NON_WORD})")
    blocks = F.when(F.lit(not windows) & maybe_block, F.split("text", "\n")).otherwise(F.array().cast("array<string>"))

    def block_tokens(line: Column) -> Column:
        return F.array_intersect(F.array(*map(F.lit, order)), alnum_words(ascii_lower(line)))  # in the global order

    def distinct(line: Column) -> Column:
        return F.size(F.array_distinct(alnum_words(line)))

    candidates = F.filter(F.transform(blocks, lambda line: F.struct(block_tokens(line).alias("tokens"), distinct(line).alias("size"))), lambda b: F.arrays_overlap(b["tokens"], F.array(*map(F.lit, first_tokens or [""]))))
    base = base.withColumn("blocks", candidates)

    def containment(t: str) -> Column:
        """The template's largest containment in a block that passes the filters; null if none reaches the threshold."""
        own, size, least = F.array(*map(F.lit, ordered[t])), len(ordered[t]), need[t]

        def held(b: Column, template: str) -> Column:
            return F.size(F.array_intersect(F.array(*map(F.lit, ordered[template])), b["tokens"]))

        def passes(b: Column) -> Column:
            in_template = F.transform(F.filter(b["tokens"], lambda w: w.isin(prefix[t])), lambda w: F.array_position(own, w))
            place = F.array_min(in_template)  # of the block's first token in the template, from 1
            passed = (b["size"] >= least) & place.isNotNull() & (size - place + 1 >= least)
            for u in rivals[t]:  # u is nearer: more of its tokens, or as many of a shorter template
                nearer = held(b, u) > held(b, t) if len(ordered[u]) >= size else held(b, u) >= held(b, t)
                passed = passed & ~((held(b, u) >= need[u]) & nearer)
            return passed

        shares = F.transform(F.filter("blocks", passes), lambda b: F.size(F.array_intersect(own, b["tokens"])) / F.lit(float(size)))
        return F.array_max(F.filter(shares, lambda s: s >= least / size - 1e-12))

    found = F.array().cast(_FOUND) if windows or not ordered else F.array_compact(F.array(*[F.when(containment(t).isNotNull(), F.struct(F.lit(templates[t]).alias("label"), containment(t).alias("share"), F.lit(True).alias("nearest"))) for t in ordered]))
    base = base.withColumn("places", places).withColumn("base_list", base_labels).withColumn("found", F.when(F.size("blocks") > 0, found).otherwise(F.array().cast(_FOUND)))
    if windows:
        base = base.withColumn("found", _in_windows(F.when(maybe_block, alnum_words(ascii_lower(F.col("text")))).otherwise(F.array().cast("array<string>")), ordered, prefix, need, templates))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return base.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base_list")).alias("base_labels"),
        joined(F.concat("base_list", F.col("found.label"))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("found.share")), F.lit(0.0))).alias("score"),
        joined(F.concat("base_list", F.transform(F.filter("found", lambda f: f["nearest"]), lambda f: f["label"]))).alias("nearest"),
    )
