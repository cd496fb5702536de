"""Column functions over noun phrases, texts and message histories."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: ASCII punctuation (a fixed value).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def canonical(text: Column) -> Column:
    """Underscores become spaces, other ASCII punctuation goes, letters are lower-cased, white space is collapsed."""
    return collapsed(F.lower(F.translate(F.translate(text, "_", " "), PUNCTUATION.replace("_", ""), "")))


def decorated(text: Column, prefix: str, suffix: str, only: Sequence[str] | None = None) -> Column:
    """prefix + text + suffix, for texts that are listed (trimmed, in any case) or for all; the word `geometric` stays as it is."""
    listed = F.lit(True) if only is None else F.lower(F.btrim(text)).isin([x.strip().lower() for x in only])
    return F.when((text != "geometric") & listed, F.concat(F.lit(prefix), text, F.lit(suffix))).otherwise(text)


def pruned_history(messages: DataFrame, conversation: str, turn: str, role: str, head: int = 2, answer: str = "assistant") -> DataFrame:
    """The first `head` messages of each conversation, and those from its last answer on."""
    w = Window.partitionBy(conversation)
    last = F.max(F.when(F.col(role) == answer, F.col(turn))).over(w)
    place = F.row_number().over(w.orderBy(turn))
    return messages.withColumn("_last", last).withColumn("_place", place).where((F.col("_place") <= head) | (F.col(turn) >= F.col("_last"))).drop("_last", "_place")


# ---- a byte-pair codec for phrases: cleaning, words, merges, ids


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references resolved twice, as texts that were escaped twice need it, and trimmed."""
    return text.map(lambda t: None if t is None else html.unescape(html.unescape(t)).strip())


def cleaned(text: Column, kind: str) -> Column:
    """kind: whitespace (runs of it as one space), lower (and lower case), canonicalize (and without punctuation). Broken encodings are left as they are."""
    ways = {"whitespace": collapsed, "lower": lambda t: F.lower(collapsed(t)), "canonicalize": canonical}
    return ways[kind](unescaped(text))


def canonical_keeping(text: Column, kept: str) -> Column:
    """canonical(), but an exact string such as `{}` stays wherever it stands."""
    parts = F.split(F.replace(text, F.lit("_"), F.lit(" ")), re.escape(kept))
    bare = F.transform(parts, lambda p: F.translate(p, PUNCTUATION, ""))
    return F.btrim(F.regexp_replace(F.lower(F.array_join(bare, kept)), r"\s+", " "))


def symbol_pairs(symbols: Column) -> Column:
    """The distinct pairs of neighbours in an array of symbols."""
    pairs = F.transform(F.slice(symbols, F.lit(1), F.greatest(F.size(symbols) - 1, F.lit(0))), lambda s, i: F.struct(s.alias("a"), F.get(symbols, i + 1).alias("b")))
    return F.array_distinct(pairs)


#: Fixed value: what is a word of a cleaned phrase.
WORDS = r"(?iu)'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def words(text: Column, special: tuple[str, ...] = ()) -> Column:
    pattern = WORDS.replace("(?iu)", "(?iu)" + "".join(re.escape(s) + "|" for s in special))
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def byte_symbols() -> dict[int, str]:
    """A visible character for each byte: its own in Latin-1 if that is visible, else one from 256 on, in order."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(visible))}


class Codec:
    """Ids of words by merges, a list of symbol pairs, best first. Ids: bytes, bytes at a word's end, merges, special tokens, in this order."""

    END = "</w>"

    def __init__(self, merges: list[tuple[str, str]], special: tuple[str, ...] = ("<start_of_text>", "<end_of_text>")):
        self.byte = byte_symbols()
        alphabet = sorted(self.byte, key=lambda b: (ord(self.byte[b]) > 255, b))
        tokens = [self.byte[b] for b in alphabet]
        tokens += [t + self.END for t in tokens] + [a + b for a, b in merges] + list(special)
        self.id_of = {t: k for k, t in enumerate(tokens)}
        self.token_of = dict(enumerate(tokens))
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.special = set(special)
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        """While some neighbouring pair is a merge, the best one is merged wherever it stands."""
        if word in self.known:
            return self.known[word]
        if word in self.special:
            return [self.id_of[word]]
        parts = [self.byte[b] for b in word.encode()]
        parts[-1] += self.END
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            merged: list[str] = []
            for part in parts:
                if merged and (merged[-1], part) == best:
                    merged[-1] += part
                    # What was just made can't begin another pair of this kind in the same pass.
                    merged.append("")
                else:
                    merged.append(part)
            parts = [p for p in merged if p]
        ids = [self.id_of[p] for p in parts]
        if len(self.known) < 100_000:
            self.known[word] = ids
        return ids

    def text(self, ids: list[int]) -> str:
        """The bytes of the tokens; a word's end is a space."""
        back = {c: b for b, c in self.byte.items()}
        joined = "".join(self.token_of[k] for k in ids)
        return bytes(back[c] for c in joined).decode(errors="replace").replace(self.END, " ")


def encoded(words_: Column, merges: list[tuple[str, str]], special: tuple[str, ...] = ("<start_of_text>", "<end_of_text>")) -> Column:
    """Ids of an array of words. The merges go to each task once, with the function."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(merges, special)
        for batch in batches:
            yield batch.map(lambda ws: None if ws is None else [k for w in ws for k in codec.word(w)])

    return ids(words_)


def decoded(ids_: Column, merges: list[tuple[str, str]], special: tuple[str, ...] = ("<start_of_text>", "<end_of_text>")) -> Column:
    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(merges, special)
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else codec.text([int(k) for k in ids]))

    return texts(ids_)


def framed(ids: Column, start: int, end: int, context: int) -> Column:
    """start, ids, end, filled up with 0 to the context; what is too long is cut, and then the last one is the end."""
    cut = F.concat(F.array(F.lit(start)), F.slice(ids, 1, context - 2), F.array(F.lit(end)))
    return F.concat(cut, F.array_repeat(F.lit(0), F.greatest(F.lit(context) - F.size(cut), F.lit(0))))
