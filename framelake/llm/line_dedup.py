"""Line dedup by a segment-partition edit join.

Lines that lie within `edits` edits of an earlier line go, and, if asked for, lines that differ from an earlier one in one word. Of two such lines, the shorter one, cut into edits + 1 segments, has a segment that stands unchanged in
the longer one, near its own place. Each distinct line is indexed under the hashes of (length, segment number, segment), and probes, for its own and each shorter
length that is near enough, the substrings that can be such a segment (multi-match-aware positions). Lines that meet but differ in too many words, by a parity of
their words, part again in the join itself. The other pairs are verified on their texts: what both begin
and end with is cut off, and the rest is compared in a band of 2 * edits + 1 diagonals, held as bits of one integer.

One word replaced, added or taken away is an edit of words: halves of the word sequence, in the same way, name the lines that can have such a neighbour; those meet
under the hashes of their words without one of them, where each group's earliest line decides, so no pairs are made.

Keys that very many lines share make no pairs: at one edit, their lines are compared by the hashes that they have without one of their characters, in the same way.

All is DataFrame expressions. Exact copies of a line are one row before lines meet, so a line that many documents share meets nothing more often than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

EDITS = 1
#: Shorter lines have no near copies: headings and the like are alike without being copies.
MIN_CHARS = 40
#: A word that differs may take this share of a line's characters, so the edits it may cost grow with the line.
WORD_SHARE = 0.25
#: Line ids, of 8 bytes each, that are broadcast to fetch texts; more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Lines that may meet under one segment key; at one edit, those of keys with more are compared by the texts that they have without a character, not in pairs.
CROWDED_KEY = 512
_LAST = 2**63 - 1
_WORD_KEYS = ["w0", "w1", "w2", "w3"]
_BLANK = " \t\r\x0b\x0c"


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, mark (a hash of the whole text), place, line_no (from 0), text and line (a hash of the trimmed text) of the lines of at least min_chars code points.

    place orders lines by doc_id, then line number: one number, since the least of a struct is sought by sorting.
    """
    text = F.btrim("raw", F.lit(_BLANK))
    order_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    place = order_id.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")
    return (
        docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
        .select("doc_id", "mark", "line_no", text.alias("text"))
        .where(F.char_length("text") >= min_chars)
        .select("doc_id", "mark", place.alias("place"), "line_no", "text", F.xxhash64("text").alias("line"))
    )


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i (from 0) of a line: all as long as can be, the last ones by one longer."""
    n = edits + 1
    short = (length / n).cast("int")
    extra = length - short * n  # so many segments, the last ones, are longer
    return short * i + F.greatest(F.lit(0), extra - (n - i)), short + F.when(i >= n - extra, 1).otherwise(0)


def _key(text: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(text, start + 1, size))


def _index_keys(text: Column, edits: int) -> list[Column]:
    length = F.char_length(text)
    return [_key(text, length, i, *_segment(length, i, edits)) for i in range(edits + 1)]


def _probe_keys(text: Column, edits: int) -> list[Column]:
    """Keys of the substrings at which a segment of a line that is no longer can stand; those of its own segments are among the index keys."""
    out = []
    for shorter in range(edits + 1):
        length = F.char_length(text) - shorter
        for i in range(edits + 1):
            start, size = _segment(length, i, edits)
            least, most = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            out += [_key(text, length, i, start + move, size) for move in range(least, most + 1) if (shorter, move) != (0, 0)]
    return out


def _words(text: Column) -> Column:
    return F.split(text, f"[{_BLANK}]+")


def _word_keys(text: Column) -> list[Column]:
    """Keys of the halves of a line's words: its own, and those that a line of one word less has if it lacks one of these."""
    words = _words(text)
    n = F.size(words)
    out = []
    for shorter in (0, 1):
        for i in (0, 1):
            start, size = _segment(n - shorter, i, 1)
            out.append(F.xxhash64(n - shorter, F.lit(i), F.slice(words, start + 1 + shorter * i, size)))
    return out


def _patterns(texts: DataFrame, items: Column, fits: Column) -> DataFrame:
    """(line, first, key, side): a line's items without one of them, at its place among as many (side 0) and as a whole (2), and all items (1), of texts(line, first, text).

    fits says which items may go, by `item` and `chars`, the length of the line. A sequence's hash is the XOR of the hashes of its items with their places. That of the
    rest is made of what stands before an item and, one place earlier, behind it, by running XORs, so the work is linear in the items of a line.
    """
    split = texts.select("line", "first", F.char_length("text").alias("chars"), F.posexplode(items).alias("i", "item"))
    own = split.select("line", "first", "i", fits.alias("fits"), F.xxhash64("i", "item").alias("h"), F.xxhash64(F.col("i") - 1, "item").alias("moved"))
    line = Window.partitionBy("line", "first")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = own.select("*", F.bit_xor("h").over(upto).alias("h_upto"), F.bit_xor("moved").over(upto).alias("moved_upto"), F.bit_xor("h").over(line).alias("h_all"), F.bit_xor("moved").over(line).alias("moved_all"), F.count("*").over(line).alias("n"))
    rest = F.col("h_upto").bitwiseXOR(F.col("h")).bitwiseXOR(F.col("moved_all")).bitwiseXOR(F.col("moved_upto"))
    made = runs.select("line", "first", "i", "n", "fits", "h_all", rest.alias("rest"))
    pattern = lambda key, side: F.struct(key.alias("key"), F.lit(side).alias("side"))
    without = F.when(F.col("fits"), F.array(pattern(F.xxhash64("n", "i", "rest"), 0), pattern(F.col("rest"), 2))).otherwise(F.array())
    whole = F.when(F.col("i") == 0, F.array(pattern(F.col("h_all"), 1))).otherwise(F.array())
    return made.select("line", "first", F.explode(F.concat(without, whole)).alias("p")).select("line", "first", "p.key", "p.side")


def _word_patterns(texts: DataFrame, share: float) -> DataFrame:
    return _patterns(texts, _words(F.col("text")), F.char_length("item") <= F.col("chars") * share)


def _char_patterns(texts: DataFrame) -> DataFrame:
    return _patterns(texts, F.split("text", ""), F.lit(True))


#: For each word of a line, one of 64 bits is turned. An edit takes away or adds at most three words in all (a space that joins or parts two), so lines within
#: `edits` edits differ in at most three times as many bits.
_WORD_PARITY = "aggregate(split(text, ' '), 0L, (s, w) -> s ^ shiftleft(1L, cast(pmod(xxhash64(w), 64) as int)))"
_BITS_PER_EDIT = 3


def _common(a: Column, b: Column, most: Column) -> Column:
    """How many characters both begin with, by halving steps; most: no more than these."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    taken = lambda at, step: (at + step <= most) & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(taken(at, step), at + step).otherwise(at))


def _band(longer: Column, shorter: Column, edits: int) -> Column:
    """Edit distance if it is at most `edits`, else some larger number; longer is by at most `edits` characters longer.

    Bit b of a column j stands for row j - edits + b. A bit of d0 says that a cell equals the one diagonally before it; vp and vn say where a cell is one more or one
    less than the one above. The distance is that of the first cell of the last cell's diagonal, and one more for each step along it without its bit in d0.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def compare(pair: Column) -> Column:
        rows, columns = pair["rows"], pair["columns"]
        bit = F.size(rows) - F.size(columns) + edits

        def step(s: Column, j: Column) -> Column:
            own = F.get(columns, j - 1)
            same = F.lit(0).cast("long")
            for b in range(width):
                same = same.bitwiseOR(F.when(F.get(rows, j - edits + b - 1) == own, F.lit(1 << b)).otherwise(F.lit(0)).cast("long"))

            def moved(x: Column) -> Column:
                d0, vp, vn = x["d0"], s["vp"], s["vn"]
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(mask).cast("long"))
                hn = d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)
                off = F.when(F.getbit(d0, bit) == 0, 1).otherwise(0)
                return F.struct(
                    hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(mask).cast("long")).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (s["distance"] + off).alias("distance"),
                )

            d0 = lambda pm: (pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(pm).bitwiseOR(s["vn"]).bitwiseAND(F.lit(mask).cast("long"))
            return F.when(s["distance"] > edits, s).otherwise(let(let(same, lambda pm: F.struct(d0(pm).alias("d0"))), moved))

        start = F.struct(F.lit(mask - ((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), (F.size(rows) - F.size(columns)).alias("distance"))
        return F.aggregate(F.sequence(F.lit(1), F.size(columns)), start, step, lambda s: s["distance"])

    chars = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    measured = let(F.struct(chars(longer).alias("rows"), chars(shorter).alias("columns")), compare)
    return F.when(shorter == "", F.char_length(longer)).otherwise(measured)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts lie within so many edits."""
    longer, shorter = F.when(F.char_length(a) >= F.char_length(b), a).otherwise(b), F.when(F.char_length(a) >= F.char_length(b), b).otherwise(a)

    def trimmed(p: Column) -> Column:
        x, y = p["x"], p["y"]
        begin = _common(x, y, F.char_length(y))
        cut = lambda s, n: F.substring(s, n + 1, F.char_length(s))
        return let(begin, lambda n: F.struct(F.reverse(cut(x, n)).alias("x"), F.reverse(cut(y, n)).alias("y")))

    rest = let(let(F.struct(longer.alias("x"), shorter.alias("y")), trimmed), trimmed)
    close = F.char_length(longer) - F.char_length(shorter) <= edits
    return F.when(close, let(rest, lambda p: _band(p["x"], p["y"], edits)) <= edits).otherwise(F.lit(False))


def _texts(occurrences: DataFrame, ids: DataFrame) -> DataFrame:
    """line, text, by_word and first place of the lines of ids(line, by_word)."""
    wanted = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    return occurrences.join(wanted, "line").groupBy("line", "text", "by_word").agg(F.min("place").alias("first"))


def _behind_by_a_pattern(patterns: DataFrame) -> DataFrame:
    """The lines of patterns(line, first, key, side) that meet an earlier one in a pattern: each key's earliest line decides, so no pairs are made."""
    made = written(patterns, "line-patterns")
    first = made.groupBy("key").agg(*[F.min(F.when(F.col("side") == side, F.col("first"))).alias(f"first_{side}") for side in range(3)], F.count("*").alias("n")).where("n > 1")
    other = F.when(F.col("side") == 0, F.col("first_0")).when(F.col("side") == 1, F.col("first_2")).otherwise(F.col("first_1"))
    return made.join(first, "key").where(other < F.col("first")).select("line")


def _sharing(keys: DataFrame) -> DataFrame:
    """The rows of keys(line, key) whose key another line has too, with n, how many rows have it."""
    shared = keys.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.count("*").alias("n")).where("a != b").select("key", "n")
    return keys.join(shared, "key")


def dropped_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, word_share: float | None = None, short_repeats: bool = False, crowded_key: int = CROWDED_KEY) -> DataFrame:
    """doc_id, mark and line_nos (from 0, in order) of the documents that lose lines."""
    text = F.col("text")
    n_index = edits + 1
    exprs = {f"k{i}": k for i, k in enumerate([*_index_keys(text, edits), *_probe_keys(text, edits)])}
    keys = [*exprs]
    if word_share is not None:
        exprs |= zip(_WORD_KEYS, _word_keys(text))
    # One pass over the texts makes the keys of all lines; where a line stands is read again from there.
    found = lines_of(docs, 1 if short_repeats else min_chars)
    every = written(found.select("doc_id", "mark", "place", "line_no", "line", (F.char_length(text) >= min_chars).alias("long"), *[e.alias(name) for name, e in exprs.items()]), "line-places")
    all_lines = written(every.groupBy("line", "long", *exprs).agg(F.min("place").alias("first"), F.count("*").alias("n")), "lines")
    distinct = all_lines.where("long")

    # Texts are fetched once, of the lines that share a key with another.
    of = lambda names: distinct.select("line", F.posexplode(F.array(*names)).alias("i", "key"))
    sharing = written(_sharing(of(keys)), "line-keys")
    ids = sharing.select("line", F.lit(False).alias("by_word"))
    if word_share is not None:
        ids = ids.unionByName(_sharing(of(_WORD_KEYS).drop("i")).select("line", F.lit(True).alias("by_word")))
    ids = written(ids.groupBy("line").agg(F.bool_or("by_word").alias("by_word")), "line-ids")
    texts = written(_texts(lines_of(docs, min_chars), ids).withColumn("parity", F.expr(_WORD_PARITY)), "line-texts")

    # A key that many lines share would meet all of them with all of them. One edit is found without pairs: lines that share a text without one character.
    crowded = F.col("n") > crowded_key if edits == 1 else F.lit(False)
    side = lambda s: texts.select(F.col("line").alias(s), F.col("text").alias(f"text_{s}"), F.col("first").alias(f"first_{s}"))
    meet = lambda s: sharing.where(~crowded).join(texts.select("line", "parity"), "line").select(F.col("line").alias(s), F.col("i").alias(f"i_{s}"), F.col("key").alias(f"key_{s}"), F.col("parity").alias(f"parity_{s}"))
    meets = (F.col("key_a") == F.col("key_b")) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b"))) <= _BITS_PER_EDIT * edits)
    meeting = meet("a").where(F.col("i_a") < n_index).join(meet("b"), meets)
    pairs = written(meeting.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")

    near = pairs.join(side("a"), "a").join(side("b"), "b").where(within(F.col("text_a"), F.col("text_b"), edits))
    behind = near.select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("line"))
    if edits == 1:
        in_crowds = texts.join(sharing.where(crowded).select("line").distinct(), "line", "left_semi")
        behind = behind.unionByName(_behind_by_a_pattern(_char_patterns(in_crowds)))
    if word_share is not None:
        behind = behind.unionByName(_behind_by_a_pattern(_word_patterns(texts.where("by_word"), word_share)))
    behind = behind.distinct().withColumn("near", F.lit(True))

    repeated = all_lines.join(behind, "line", "left").where("n > 1 or near").select("line", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = every.select("doc_id", "mark", "line", "line_no", "place").join(repeated, "line").where(F.col("near") | (F.col("place") != F.col("first")))
    return gone.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("line_no")).alias("line_nos"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, word_share: float | None = None, short_repeats: bool = False, crowded_key: int = CROWDED_KEY) -> DataFrame:
    """doc_id, mark, n_lines, n_dropped and dropped (the numbers of the lines that go, from 0, joined by commas) of each row of docs(doc_id, text).

    A line of at least min_chars code points, without white space around it, goes if an earlier one (smaller doc_id, then line number) lies within `edits` edits; whether
    that one goes itself does not matter. With word_share, it also goes if it differs from an earlier one in one word, replaced, added or taken away, that takes at most
    that share of the characters of each line that has it. Shorter lines stay; with short_repeats, exact repeats of those go too, blank lines aside. Rows that repeat a document's id and text lose the same lines; of lines at one place neither is earlier.
    A null doc_id comes after all others. A null text has no lines and loses none.
    """
    lost = dropped_lines(docs, edits, min_chars, word_share, short_repeats, crowded_key).select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), "line_nos")
    base = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    joined = base.join(lost, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")), "left")
    nos = F.coalesce("line_nos", F.array().cast("array<int>"))
    return joined.select("doc_id", "mark", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.size(nos).cast("long").alias("n_dropped"), F.array_join(nos.cast("array<string>"), ",").alias("dropped"))


def without_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, word_share: float | None = None, short_repeats: bool = False) -> DataFrame:
    """docs with the dropped lines taken out of text; all rows and columns stay, whatever their names."""
    lost = dropped_lines(docs.select("doc_id", "text"), edits, min_chars, word_share, short_repeats).select(F.struct("doc_id", "mark", "line_nos").alias("lost"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, doc_id = F.col("row.text"), F.col("row.doc_id")
    joined = rows.join(lost, doc_id.eqNullSafe(F.col("lost.doc_id")) & (F.xxhash64(text) == F.col("lost.mark")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("lost.line_nos", i)), "\n")
    left = F.when(F.col("lost.line_nos").isNull(), text).otherwise(kept)
    return joined.select(*[left.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
