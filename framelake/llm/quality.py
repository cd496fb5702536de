"""Quality rules: word and line statistics, and tokeniser fertility with rejection bands per script.

Fertility: public vocabularies cut each word; characters per token, the share of tokens that are fallback bytes, and the entropy of a text's tokens show what
is no prose of its script. Words are cut one by one, so each worker keeps the cuts of the words that it has met, in a cache of bounded size; a batch's words are
counted with numpy. The work is a map over documents: nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 50
#: Words whose cuts a worker keeps, at about 200 bytes each.
CACHED_WORDS = 100_000
#: Text that a worker measures at a time.
PART_BYTES = 1_000_000
#: Tokens of one word that count towards tokens per word: a few keys or URLs in a short clean text must not decide.
WORD_TOKENS = 12

#: Rejection bands by script: (least, most) characters per token of the piece vocabulary and of the byte vocabulary, share of fallback bytes,
#: token entropy in bits, and, where words stand apart, tokens per word, of a word WORD_TOKENS at most. A text is rejected outside any of them. They are wide: prose of any topic and length from MIN_WORDS on lies inside.
BANDS: dict[str, dict[str, tuple[float, float]]] = {
    "latin": {"piece_chars": (1.4, 7.0), "byte_chars": (1.3, 8.0), "byte_share": (0.0, 0.10), "entropy": (5.0, 16.0), "fertility": (1.0, 3.5)},
    "cyrillic": {"piece_chars": (1.2, 6.0), "byte_chars": (0.6, 4.0), "byte_share": (0.0, 0.15), "entropy": (4.0, 16.0)},
    "greek": {"piece_chars": (0.7, 5.0), "byte_chars": (0.4, 3.0), "byte_share": (0.0, 0.60), "entropy": (3.5, 16.0)},
    "han": {"piece_chars": (0.3, 3.0), "byte_chars": (0.2, 2.0), "byte_share": (0.0, 0.85), "entropy": (4.0, 16.0)},
    "other": {"piece_chars": (0.2, 8.0), "byte_chars": (0.2, 8.0), "byte_share": (0.0, 1.0), "entropy": (3.0, 16.0)},
}
#: Code points of the letters of each script; `other` takes all letters besides.
SCRIPTS = [
    ("latin", [(0x41, 0x24F), (0x1E00, 0x1EFF)]),
    ("cyrillic", [(0x400, 0x52F)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("han", [(0x2E80, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]),
    ("other", []),
    ("none", []),
]
_SPACE = " \t\n\x0b\x0c\r"
_SCHEMA = (
    "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, piece_chars double,"
    " byte_chars double, byte_share double, entropy double, fertility double"
)


@functools.cache
def _vocabularies(piece_path: str, byte_path: str, pattern: str):
    import sentencepiece
    import tiktoken

    piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_path, "rb"))}
    return piece, tiktoken.Encoding("public_bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Cuts:
    """The words that a worker has met, numbered, and of each: its pieces, how many are fallback bytes, how many tokens the byte vocabulary needs.

    flat holds all pieces, those of word k from begin[k] to begin[k + 1]. Beyond CACHED_WORDS the cache starts anew with the next part.
    """

    def __init__(self, *paths: str):
        self.piece, self.bytes = _vocabularies(*paths)
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.n_bytes = self.n_byte_tokens = self.script = np.zeros(0, np.int64)

    def ids(self, split: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words, text by text."""
        if len(self.number) > CACHED_WORDS:
            self.clear()
        number, old = self.number, len(self.number)
        ids = np.fromiter((number.setdefault(w, len(number)) for words in split for w in words), np.int64, sum(map(len, split)))
        if len(number) > old:
            texts = [w.decode() for w in itertools.islice(reversed(number), len(number) - old)][::-1]
            pieces = self.piece.encode(texts, num_threads=1)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = np.fromiter(itertools.chain.from_iterable(pieces), np.int32, sizes.sum())
            begin = np.concatenate([[0], np.cumsum(sizes)])
            fallback = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
            self.script = np.concatenate([self.script, np.fromiter(map(_script_of, texts), np.int64, len(texts))])
            cut = self.bytes.encode_ordinary
            self.n_byte_tokens = np.concatenate([self.n_byte_tokens, np.fromiter((len(cut(" " + t)) for t in texts), np.int64, len(texts))])
            self.n_bytes = np.concatenate([self.n_bytes, fallback[begin[1:]] - fallback[begin[:-1]]])
            self.flat, self.begin = np.concatenate([self.flat, flat]), np.concatenate([self.begin, self.begin[-1] + begin[1:]])
        return ids


def _script_of(word: str) -> int:
    """The number in SCRIPTS of a word's first letter; the last for words without letters."""
    for c in word:
        if c.isalpha():
            code = ord(c)
            return next((k for k, (_, ranges) in enumerate(SCRIPTS[:-2]) if any(a <= code <= b for a, b in ranges)), len(SCRIPTS) - 2)
    return len(SCRIPTS) - 1


def _repeat_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, its words inside 3-word windows that its text has twice or more."""
    if len(ids) < 3:
        return np.zeros(n_docs, np.int64)
    own = doc[:-2] == doc[2:]
    where = np.flatnonzero(own)
    # Exact keys: pairs of ids numbered anew, then (document, pair, id) numbered by sorting.
    pair = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_inverse=True)[1]
    keys = np.stack([doc[where].astype(np.int64), pair[where] << 32 | ids[where + 2].astype(np.int64)], axis=1)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    k = keys[order]
    same = (k[1:] == k[:-1]).all(axis=1)
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = where[order[twice]]
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return np.bincount(doc[covered], minlength=n_docs)


def _measure(batches: Iterator[pa.RecordBatch], cuts_of) -> Iterator[pa.RecordBatch]:
    cuts = cuts_of()
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(sizes):  # parts of about PART_BYTES of text, a very long text alone
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:], dtype=np.int64), PART_BYTES, side="right")))
            own = whole.slice(at, min(end, len(sizes)) - at)
            yield _measured(own.column("doc_id"), [t or "" for t in own.column("text").to_pylist()], cuts)
            at = end


def _measured(doc_ids: pa.Array, texts: list[str], cuts: _Cuts) -> pa.RecordBatch:
    n = len(texts)
    split = [t.encode().split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    ids = cuts.ids(split)
    doc = np.repeat(np.arange(n), n_words)
    lines = [[x for x in t.split("\n") if x.strip(_SPACE)] for t in texts]
    word_chars = np.array([len(t) - sum(map(t.count, _SPACE)) for t in texts], np.int64)
    sizes = np.diff(cuts.begin)
    total = lambda per_word: np.bincount(doc, weights=per_word[ids], minlength=n) if len(ids) else np.zeros(n)
    tokens, byte_tokens, fallback = total(sizes), total(cuts.n_byte_tokens), total(cuts.n_bytes)
    # Token counts of each document: its distinct words times their pieces.
    sum_c = np.zeros(n)
    if len(ids):
        pairs, times = np.unique(doc.astype(np.int64) << 32 | ids, return_counts=True)
        p_doc, p_word = pairs >> 32, pairs & 0xFFFFFFFF
        reps = sizes[p_word]
        inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        keys = np.repeat(p_doc, reps) << 20 | cuts.flat[np.repeat(cuts.begin[p_word], reps) + inside]
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], np.repeat(times, reps)[order]
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            c = np.add.reduceat(weights, first).astype(float)
            sum_c = np.bincount(keys[first] >> 20, weights=c * np.log2(c), minlength=n)
    some = np.maximum(tokens, 1)
    by_script = np.bincount(doc * len(SCRIPTS) + cuts.script[ids], minlength=n * len(SCRIPTS)).reshape(n, len(SCRIPTS))  # the script of most words
    columns = {
        "doc_id": doc_ids,
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": np.array([sum(map(t.count, "#*$%&|<>")) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": _repeat_words(ids, doc, n).astype(np.int64),
        "script": [SCRIPTS[k][0] for k in by_script[:, :-1].argmax(axis=1)],
        "n_tokens": tokens.astype(np.int64),
        "piece_chars": word_chars / some,
        "byte_chars": word_chars / np.maximum(byte_tokens, 1),
        "byte_share": fallback / some,
        "entropy": np.where(tokens > 0, np.log2(some) - sum_c / some, 0.0),
        "fertility": total(np.minimum(sizes, WORD_TOKENS)) / np.maximum(n_words, 1),
    }
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _default_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def measure(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """The statistics and fertility of each row of docs(doc_id, text); null texts have no words, and zeros. paths: piece model, byte ranks, byte pattern."""
    paths = paths or _default_paths()
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _measure(batches, lambda: _Cuts(*paths)), _SCHEMA.format(id=kind))


def good_documents(docs: DataFrame, paths: tuple[str, str, str] | None = None, bands: Mapping[str, Mapping[str, tuple[float, float]]] = BANDS) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    paths = paths or _default_paths()
    schema = T._parse_datatype_string(_SCHEMA.split(", ", 1)[1])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _Cuts(*paths)
        for b in batches:
            if b.num_rows:
                at = 0
                for own in _measure(iter([b]), lambda: cuts):  # part by part, so that neither side holds a second batch
                    part = b.slice(at, own.num_rows)
                    at += own.num_rows
                    yield pa.RecordBatch.from_arrays([*part.columns, *own.columns[1:]], [*part.schema.names, *(f"measured {n}" for n in own.schema.names[1:])])

    held = docs.mapInArrow(beside, T.StructType([*docs.schema.fields, *(T.StructField(f"measured {f.name}", f.dataType) for f in schema.fields)]))
    row = held.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`measured {f.name}`").alias(f.name) for f in schema.fields])
    return judge(row, bands).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def judge(measured: DataFrame, bands: Mapping[str, Mapping[str, tuple[float, float]]] = BANDS) -> DataFrame:
    """base_failed and kept beside the statistics: kept if the base rules hold and every fertility lies in the band of the text's script."""
    fits = F.lit(True)
    for script, own in bands.items():
        inside = F.lit(True)
        for name, (least, most) in own.items():
            inside = inside & F.col(name).between(least, most)
        fits = fits & ((F.col("script") != script) | inside)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fits)
