"""Byte-pair encoding and decoding with public tokenizer files.

Texts become one flat array of code points; class changes give the pre-tokens of
all texts at once, a hash finds the distinct ones, and only those not met before
in the task are merged.  Merging runs in rounds over one flat array of symbols of
many words: binary search over sorted pair keys gives the rank of every pair, and
each word applies its lowest one.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from . import ragged

SPACE, LETTER, NUMBER, OTHER, CUT, SPECIAL = range(6)
# Lone surrogates cannot occur in texts: one ends a text, the following ones are special tokens.
_END = 0xD800
END = chr(_END)
_NO_RANK = np.iinfo(np.int32).max
# Words kept between pieces of a task, and the longest word kept.
KNOWN_WORDS = 1 << 18
KNOWN_LENGTH = 64
_LONG_TEXT = 1 << 20


class Classes(NamedTuple):
    """Where the class of characters changes, over all code points but lone surrogates."""

    starts: np.ndarray
    kinds: np.ndarray


@functools.cache
def class_changes(split: bool) -> Classes:
    """Character classes of the library's ``Split`` step or else of its byte-level step.

    The two know different versions of Unicode, so the library itself is asked: the step
    cuts the text of all code points where their class changes, and one character of each
    part tells the class by whether it joins a letter, a number or a mark.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 0x20)
    codes = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    if split:
        table = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            step = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
            for _, (low, high) in step.pre_tokenize_str(every):
                table[codes[low:high]] = kind
    else:
        table = np.full(0x110000, SPACE, np.uint8)
        step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        for _, (low, high) in step.pre_tokenize_str(every):
            for mark, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
                if len(step.pre_tokenize_str(mark + every[low])) == 1:
                    table[codes[low:high]] = kind
    table[0x20] = SPACE
    table[0xD800:0xE000] = SPECIAL
    table[_END] = CUT
    starts = np.flatnonzero(np.diff(table, prepend=255))
    return Classes(starts, table[starts])


_given: dict[bool, Classes] = {}


def use_classes(split: bool, changes: Classes) -> None:
    """Take the classes the driver has found, so that a task need not ask the library again."""
    _given.setdefault(split, changes)


@functools.cache
def _classes(split: bool) -> np.ndarray:
    """Class of every code point."""
    starts, kinds = _given.get(split) or class_changes(split)
    return np.repeat(kinds, np.diff(starts, append=0x110000))


class Pairs:
    """Merge rules as sorted keys with their rank and product."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        # All pairs of a word's lowest rank may merge together if a merge never
        # makes a pair of lower rank; then order inside a rank does not matter.
        first = np.full(max(vocabulary.values()) + 1, -1, np.int64)
        first[made] = np.arange(len(made))
        used = np.maximum(first[left], first[right])
        self.together = len(np.unique(made)) == len(made) and bool(
            (used < np.arange(len(made))).all()
        )

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (a large number if no rule has it) and the rule's place."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NO_RANK), at

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words; returns the symbols left and their number per word."""
        symbols, lengths = symbols.astype(np.int32), lengths.astype(np.int64)
        final = lengths.copy()
        word = np.flatnonzero(lengths > 0)
        lengths = lengths[word]
        starts = np.cumsum(lengths) - lengths
        ranks = np.full(len(symbols), _NO_RANK, np.int32)
        places = np.zeros(len(symbols), np.int64)
        paired = np.ones(len(symbols), bool)
        paired[starts + lengths - 1] = False  # the last symbol of a word has no partner
        stale = np.flatnonzero(paired)
        done_symbols, done_words = [], []
        while len(word):
            ranks[stale], places[stale] = self.find(symbols[stale], symbols[stale + 1])
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest < _NO_RANK
            if not going.all():
                mine = np.repeat(going, lengths)
                done_symbols.append(symbols[~mine])
                done_words.append(np.repeat(word[~going], lengths[~going]))
                symbols, ranks, places, paired = (x[mine] for x in (symbols, ranks, places, paired))
                word, lengths, lowest = word[going], lengths[going], lowest[going]
                if not len(word):
                    break
                starts = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            hits = self._chosen(hits, starts)
            symbols[hits] = self.made[places[hits]]
            paired[hits] = paired[hits + 1]
            ranks[hits] = _NO_RANK
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            gone = np.bincount(np.searchsorted(starts, hits, side="right") - 1, minlength=len(word))
            lengths = lengths - gone
            final[word] = lengths
            starts = np.cumsum(lengths) - lengths
            symbols, ranks, places, paired = (x[keep] for x in (symbols, ranks, places, paired))
            # Only the pairs a merged symbol takes part in have a new rank.
            hits = hits - np.arange(len(hits))
            stale = np.concatenate((hits, hits[hits > 0] - 1))
            stale = stale[paired[stale]]
        if not done_symbols:
            return symbols, final
        order = np.argsort(np.concatenate(done_words), kind="stable")
        return np.concatenate(done_symbols)[order], final

    def _chosen(self, hits: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hits that merge in this round: of overlapping ones every other, from the left."""
        if self.together:
            fresh = np.ones(len(hits), bool)
            fresh[1:] = hits[1:] != hits[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            return hits[(np.arange(len(hits)) - run) % 2 == 0]
        owner = np.searchsorted(starts, hits, side="right")
        return hits[np.concatenate(([True], owner[1:] != owner[:-1]))]


class Rules(NamedTuple):
    pairs: Pairs
    first: np.ndarray  # symbol of each byte
    last: np.ndarray  # symbol of each byte at a word's end
    tokens: dict[int, str]
    specials: dict[str, int]
    single_numbers: bool  # each number character is a word, and spaces are dropped
    lower: bool
    byte_decoder: bool


def _byte_letters() -> list[str]:
    """The public mapping of bytes to printable characters used by byte-level files."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.cache
def rules(path: str) -> Rules:
    """Load a byte-level BPE file of the tokenizers library.

    Two kinds are known: words with an end mark (lower case, white space dropped)
    and words that keep a leading space.  Another setting raises an error.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    suffix = model.get("end_of_word_suffix") or ""
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocabulary, letters = model["vocab"], _byte_letters()
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {i: t for t, i in vocabulary.items()} | {i: t for t, i in specials.items()}
    return Rules(
        Pairs(vocabulary, merges),
        np.array([vocabulary[c] for c in letters], np.int32),
        np.array([vocabulary[c + suffix] for c in letters], np.int32),
        tokens,
        specials,
        bool(suffix),
        spec["normalizer"] is not None,
        spec["decoder"] is not None,
    )


def _prepared(rule: Rules, text: str) -> str:
    for place, special in enumerate(rule.specials, 1):
        if special in text:
            text = text.replace(special, chr(_END + place))
    if rule.lower:
        # Python's tables may be of another Unicode version beyond the Latin letters.
        text = text.lower() if text.isascii() or not _FAR.search(text) else _normal(text)
    return text


# From here on letters combine, have special lower-case forms or differ by version.
_FAR = re.compile("[\u0130\u0300-\ud7ff\ue000-\U0010ffff]")
_NORMALIZER = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def _normal(text: str) -> str:
    return "".join(
        _NORMALIZER.normalize_str(part) if part and not _END <= ord(part[0]) < 0xE000 else part
        for part in re.split("([\ud800-\udfff])", text)
    )


def _cut(text: str, most: int) -> list[str]:
    """Cut a very long text before single spaces, where a pre-token always begins."""
    parts, low = [], 0
    while len(text) - low > most:
        found = _GAP.search(text, low + most)
        if not found:
            break
        parts.append(text[low : found.start()])
        low = found.start()
    return [*parts, text[low:]]


_GAP = re.compile(r"(?<=\S) (?=\S)")


def pre_tokens(rule: Rules, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, starts and ends of the pre-tokens, and the ends of the texts."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes(rule.single_numbers)[codes]
    n = len(codes)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins |= kind >= CUT
    if rule.single_numbers:
        begins |= kind == NUMBER
    # What follows a position; nothing follows the last one, which is always a cut.
    after = np.full(n + 4, CUT, np.uint8)
    after[:n] = kind
    chars = np.zeros(n + 4, np.uint32)
    chars[:n] = codes
    quotes = np.flatnonzero((codes == 0x27) & begins)
    quotes = quotes[after[quotes + 1] == LETTER]
    if not rule.single_numbers:
        quotes = quotes[(quotes == 0) | (chars[quotes - 1] != 0x20)]
        spaces, ends = ragged.runs(kind == SPACE)
        followed = after[ends] < CUT
        last = ends[followed] - 1
        begins[last] = True
        begins[ends[followed][codes[last] == 0x20]] = False
    one, two = chars[quotes + 1], chars[quotes + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
    long |= (one == ord("l")) & (two == ord("l"))
    for found, width in ((quotes[short], 2), (quotes[long], 3)):
        begins[found + 1] = False
        rest = found + width
        begins[rest[after[rest] == LETTER]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    kept = kind[starts] != CUT
    if rule.single_numbers:
        kept &= kind[starts] != SPACE
    return codes, starts[kept], ends[kept], np.flatnonzero(kind == CUT)


class Words:
    """Merged symbols of the words met so far in a task, bounded in number."""

    def __init__(self, rule: Rules):
        self.rule = rule
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.symbols = np.zeros(0, np.int32)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words that were not met before."""
        encoded = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        data = np.frombuffer(b"".join(encoded), np.uint8)
        symbols = self.rule.first[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.rule.last[data[ends - 1]]
        return self.rule.pairs.merge(symbols, lengths)

    def look_up(
        self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the symbols of every pre-token, in ``self.symbols``."""
        which, distinct = ragged.span_ids(codes, starts, ends)
        words = distinct.to_pylist()
        if len(self.known) > KNOWN_WORDS:
            self.clear()
        at = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            symbols, lengths = self.merged([plain(w) for w in fresh])
            at[new] = len(self.starts) + np.arange(len(new))
            self.known.update(zip(fresh, at[new].tolist(), strict=True))
            begins = len(self.symbols) + np.cumsum(lengths) - lengths
            self.symbols = np.concatenate((self.symbols, symbols))
            self.starts = np.concatenate((self.starts, begins))
            self.lengths = np.concatenate((self.lengths, lengths))
        return self.starts[at][which], self.lengths[at][which]


def plain(codes: bytes) -> str:
    """The word of packed code points."""
    return codes.decode("utf-32-le", "surrogatepass")


_words: dict[str, Words] = {}


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the offsets of the texts in it."""
    rule = rules(path)
    words = _words.setdefault(path, Words(rule))
    found_ids = [np.zeros(0, np.int32)]
    lengths = np.zeros(len(texts), np.int64)
    for owners, parts in stretches(rule, texts):
        ids, counts = _encode_piece(rule, words, parts)
        found_ids.append(ids)
        np.add.at(lengths, owners, counts)
    return np.concatenate(found_ids), ragged.offsets_of(lengths)


def stretches(rule: Rules, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Prepared texts in groups of bounded size, with the text each part belongs to."""
    owners, parts, size = [], [], 0
    for row, text in enumerate(texts):
        text = _prepared(rule, text)
        for part in _cut(text, _LONG_TEXT) if len(text) > _LONG_TEXT else [text]:
            if parts and size + len(part) > _LONG_TEXT:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(row)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def is_special(codes: np.ndarray) -> np.ndarray:
    return (codes > _END) & (codes < 0xE000)


def _encode_piece(rule: Rules, words: Words, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = END.join(parts) + END
    codes, starts, ends, cuts = pre_tokens(rule, joined)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
    long = ends - starts > KNOWN_LENGTH
    ordinary = ~is_special(codes[starts])
    easy = ordinary & ~long
    begin = np.zeros(len(starts), np.int64)
    length = np.ones(len(starts), np.int64)
    if easy.any():
        begin[easy], length[easy] = words.look_up(codes, starts[easy], ends[easy])
    pool = [words.symbols]
    base = len(words.symbols)
    if not ordinary.all():
        ids = np.array([0, *rule.specials.values()], np.int32)
        pool.append(ids)
        begin[~ordinary] = base + codes[starts[~ordinary]] - _END
        base += len(ids)
    rare = ordinary & long
    if rare.any():  # long words are merged where they stand and not kept
        spans = zip(starts[rare].tolist(), ends[rare].tolist(), strict=True)
        symbols, lengths = words.merged([joined[a:b] for a, b in spans])
        pool.append(symbols)
        begin[rare], length[rare] = base + np.cumsum(lengths) - lengths, lengths
    symbols = pool[0] if len(pool) == 1 else np.concatenate(pool)
    places = np.searchsorted(starts, cuts)
    counts = ragged.sums(length, np.concatenate(([0], places)))
    return ragged.gather(symbols, begin, length), counts


def encode(
    df: DataFrame, path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None
) -> DataFrame:
    """Add the token ids of a text column as packed little-endian 32-bit numbers.

    The ids are those of the tokenizers library for the file at ``path`` without
    added special tokens, truncation or padding; a special token's string inside
    a text is that token.  ``path`` must be readable on every executor.  Null and
    empty texts give an empty value.  A text of any length is encoded whole, in
    stretches cut where a pre-token begins.  Repeated rows stay repeated, an empty
    table gives an empty one, and a column named like ``out`` is replaced.
    """
    split = rules(path).single_numbers
    changes = class_changes(split)

    def make() -> ragged.Work:
        use_classes(split, changes)

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            ids, offsets = encode_texts(path, ragged.texts(columns[0]))
            return [ragged.binaries(ids.astype("<u4").view(np.uint8), offsets * 4)]

        work.close = lambda: _words.pop(path, None)
        return work

    adds = T.StructType([T.StructField(out, T.BinaryType())])
    return ragged.with_columns(df, [text], adds, make, keep)


class Decoder:
    """Token strings in one flat array."""

    def __init__(self, path: str):
        rule = rules(path)
        self.spaced = not rule.byte_decoder
        byte_of = {c: bytes([b]) for b, c in enumerate(_byte_letters())}
        strings = []
        for i in range(max(rule.tokens) + 1):
            token = rule.tokens.get(i)
            if token is None:
                strings.append(b"")
            elif self.spaced:  # without a decoder the library joins tokens with spaces
                strings.append(token.encode("utf-8") + b" ")
            elif token in rule.specials or any(c not in byte_of for c in token):
                strings.append(token.encode("utf-8"))
            else:
                strings.append(b"".join(byte_of[c] for c in token))
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        known = ids < len(self.lengths)
        safe = np.where(known, ids, 0)
        lengths = np.where(known, self.lengths[safe], 0)
        ends = ragged.offsets_of(ragged.sums(lengths, offsets))
        data = ragged.gather(self.data, self.starts[safe], lengths)
        if self.spaced:
            keep = np.ones(len(data), bool)
            keep[ends[1:][np.diff(ends) > 0] - 1] = False
            ends = ends - np.concatenate(([0], np.cumsum(np.diff(ends) > 0)))
            data = data[keep]
            return ragged.binaries(data, ends).cast(pa.large_string())
        raw = data.tobytes()
        spans = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in spans], pa.large_string())


@functools.cache
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def decode(
    df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None
) -> DataFrame:
    """Add the text of packed ids, special tokens included, as the tokenizers library gives it.

    A file without a decoder gives the token strings joined by spaces; a byte-level
    decoder gives the bytes as UTF-8 with broken characters replaced.  Ids outside the
    vocabulary are skipped.  Null and empty ids give an empty text, ids of any length are
    decoded whole, repeated rows stay repeated, an empty table gives an empty one, and a
    column named like ``out`` is replaced.
    """

    def make() -> ragged.Work:
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            data, offsets = ragged.flat(columns[0])
            packed = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
            return [_decoder(path).decode(packed, offsets // 4)]

        return work

    adds = T.StructType([T.StructField(out, T.StringType())])
    return ragged.with_columns(df, [ids], adds, make, keep)
