"""Secret scans: patterns for known kinds, and sliding-window Shannon entropy over candidate strings of each character class.

A span is (kind, start, end) in code points of the text, end exclusive. Places of matches are found by setting two marks around each match and adding up the
lengths between them; the marks are private-use characters that no pattern takes, and a text's own copies of them are first replaced by another one.

The entropy of a window is log2(w) - (1/w) * sum of c * log2(c) over the counts c of its characters. The sum is kept while the window slides: the character that
enters raises its count, the one that leaves lowers it, and only their two terms change.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Pieces of a text that are placed at a time; even, so that each block begins outside a match.
_BLOCK = 512
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"

#: Kinds in their order, pattern, least length, and whether the length is that of the second group.
BASE_KINDS = [
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"(AKIA[A-Z0-9]{12,})", 16),  # a run of the class is one match, so the length may stand in the pattern
    ("hex", r"([0-9a-f]{32,})", 32),
]
#: What a text must hold for a kind to be looked for at all: cheap, and never false where the kind matches.
_GUARDS = {
    "assign": lambda text: (text.contains("=") | text.contains(":")) & let(F.lower(text), lambda low: low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key")),
    "access": lambda text: text.contains("AKIA"),
    "hex": lambda text: text.rlike("[0-9a-f]{32}"),
}

#: Character classes of candidate strings: name, pattern of a maximal run, its alphabet, window, least entropy in bits.
CLASSES = [
    ("entropy_hex", r"(?<![A-Za-z0-9])[0-9a-fA-F]{24,}(?![A-Za-z0-9])", "0123456789abcdefABCDEF", 24, 3.0),
    ("entropy_base64", r"[A-Za-z0-9+/=_-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 24, 4.0),
]
#: Candidates that are no secrets: words of letters alone, numbers, dates and uuids, sequences of one character, examples of documentation.
ALLOW_LIST = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*$",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|xxxx|lorem|abcdef0123456789|0123456789abcdef",
    r"^(.)\1+$",
)


def _matches(text: Column, pattern: str) -> Column:
    """start, end and string of each match of a pattern in a text without marks, left to right."""
    # Split at the marks: text between, match, between, match, ..., between.
    span = "array<struct<start:int,end:int,s:string>>"

    def inside(part: Column, start: Column) -> Column:
        """The matches of a block of pieces (every second piece is one), the block beginning at a place of the text."""
        return F.aggregate(
            part,
            F.struct(start.alias("at"), F.lit(False).alias("inside"), F.array().cast(span).alias("out")),
            lambda a, piece: F.struct(
                (a["at"] + F.length(piece)).alias("at"),
                (~a["inside"]).alias("inside"),
                F.when(a["inside"], F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(piece)).alias("end"), piece.alias("s"))))).otherwise(a["out"]).alias("out"),
            ),
            lambda a: a["out"],
        )

    def placed(pieces: Column) -> Column:
        """Blocks of _BLOCK pieces: where each begins, then the matches in it, so that no array grows with all matches of a text."""
        block = lambda k: F.slice(pieces, k * _BLOCK + 1, F.lit(_BLOCK))
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int"))
        sizes = F.transform(numbers, lambda k: F.aggregate(block(k), F.lit(0), lambda n, piece: n + F.length(piece)))
        begin = lambda k: let(sizes, lambda own: F.aggregate(F.slice(own, F.lit(1), k), F.lit(0), lambda n, x: n + x))
        return F.when(F.size(pieces) <= _BLOCK, inside(pieces, F.lit(0))).otherwise(F.flatten(F.transform(numbers, lambda k: let(begin(k), lambda at: inside(block(k), at)))))

    return let(F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]"), placed)


def _spans(matches: Column, rank: int, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _most_entropy(s: Column, alphabet: str, window: int) -> Column:
    """The largest Shannon entropy of the windows of a string, by incremental counts; null if it is shorter than a window."""
    f = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    size = len(alphabet)

    def slide(chars: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            enters, leaves = F.get(chars, i), F.when(i >= window, F.get(chars, i - window)).otherwise(F.lit(0))
            up = F.get(a["counts"], enters - 1)
            down = F.when(leaves > 0, F.get(a["counts"], leaves - 1) + F.when(leaves == enters, 1).otherwise(0)).otherwise(F.lit(0))
            total = a["sum"] + f(up + 1) - f(up) + F.when(leaves > 0, f(down - 1) - f(down)).otherwise(F.lit(0.0))
            counts = F.transform(a["counts"], lambda c, k: c + F.when(k == enters - 1, 1).otherwise(0) - F.when(k == leaves - 1, 1).otherwise(0))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= window - 1, F.least(a["least"], total)).otherwise(a["least"]).alias("least"))

        start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda a: a["least"])

    places = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.position(F.substring(s, i, F.lit(1)), F.lit(alphabet)))
    return F.when(F.length(s) >= window, F.lit(math.log2(window)) - let(places, slide) / window)


def scan_secrets(docs: DataFrame, classes: Sequence[tuple] = CLASSES, allow_list: Sequence[str] = ALLOW_LIST) -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans of each row of docs(doc_id, text); a null text is empty.

    Base spans are whole matches, leftmost and non-overlapping for each kind; matches that are too short are dropped. The method adds the spans of candidate
    strings in whose windows the entropy of their class is reached, unless the allow list fits them or a base span overlaps them. Spans are `kind:start:end`, by
    start, then kind, joined by commas. Rows that repeat are judged one by one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = text.contains(_OPEN) | text.contains(_CLOSE)
    base = docs.select("doc_id", F.when(marked, F.translate(text, _OPEN + _CLOSE, _OTHER * 2)).otherwise(text).alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def base_spans(rank: int, kind: str, pattern: str, least: int) -> Column:
        found = F.filter(_matches(F.col("text"), pattern), lambda m: F.length(F.regexp_extract(m["s"], pattern, 1)) >= least)
        return _spans(F.when(_GUARDS[kind](F.col("text")), found).otherwise(none), rank, kind)

    for rank, (kind, pattern, least) in enumerate(BASE_KINDS):
        base = base.withColumn(kind, base_spans(rank, kind, pattern, least))
    base = base.withColumn("base", F.array_sort(F.concat(*[kind for kind, _, _ in BASE_KINDS])))

    def allowed(m: Column) -> Column:
        known = F.lit(False)
        for p in allow_list:
            known = known | m["s"].rlike(p)
        return known | F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

    def entropy_spans(rank: int, kind: str, pattern: str, alphabet: str, window: int, bits: float) -> Column:
        candidates = F.filter(_matches(F.col("text"), pattern), lambda m: ~allowed(m))
        found = F.filter(candidates, lambda m: _most_entropy(m["s"], alphabet, window) >= bits)
        return _spans(F.when(F.col("text").rlike(pattern), found).otherwise(none), rank, kind)

    extra = [entropy_spans(rank, *of_class) for rank, of_class in enumerate(classes, len(BASE_KINDS))]
    spans = F.array_sort(F.concat("base", *extra)) if extra else F.col("base")
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda found: F.array_join(F.transform(found, one), ",")
    return base.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind, _, _ in BASE_KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
