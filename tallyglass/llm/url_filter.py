"""Block and allow rules for URLs, run as one bit-parallel automaton.

Rules and globs become patterns over the canonical URL.  All patterns share one
row of 64-bit words: bit j of a pattern says that its first j characters fit the
bytes read so far.  One byte moves every pattern of every URL of the batch on by a
shift, a mask of the byte, and a mask of the positions where a ``*`` waits.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged

BLOCK, ALLOW = "block", "allow"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Bytes of automaton state held for a batch of URLs.
STATE_BYTES = 8 << 20


class Rule(NamedTuple):
    """A host with its subdomains, and the start of the path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Glob(NamedTuple):
    """A pattern over ``.host/path``: ``*`` is any run of bytes, ``?`` any one byte."""

    verdict: str
    pattern: str


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, _CAPITALS, _CAPITALS.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


# A byte that no UTF-8 text has stands between host and path.
BREAK = 0xFF


class Automaton:
    """Wildcard patterns packed into multiword Shift-And masks."""

    def __init__(self, patterns: Sequence[list[int | None | str]], blind: Sequence[int] = ()):
        """Each pattern is a list of bytes, ``None`` (any one byte) or ``"*"``.

        To the patterns numbered in ``blind`` the byte ``BREAK`` is as if it were not there.
        """
        sizes = [1 + sum(p != "*" for p in pattern) for pattern in patterns]
        self.words = max(1, -(-sum(sizes) // 64))
        moves = np.zeros((256, self.words), np.uint64)
        stays = np.zeros((256, self.words), np.uint64)
        begin = np.zeros(self.words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        first = 0
        for number, pattern in enumerate(patterns):
            at = first
            word, bit = divmod(at, 64)
            begin[word] |= np.uint64(1 << bit)
            for symbol in pattern:
                if symbol == "*":
                    stays[:, at // 64] |= np.uint64(1 << at % 64)
                    continue
                at += 1
                rows = slice(None) if symbol is None else symbol
                moves[rows, at // 64] |= np.uint64(1 << at % 64)
            self.accept.append((at // 64, np.uint64(1 << at % 64)))
            if number in blind:
                for own in range(first, at + 1):
                    bit = np.uint64(1 << own % 64)
                    moves[BREAK, own // 64] &= ~bit
                    stays[BREAK, own // 64] |= bit
            first = at + 1
        self.moves, self.stays, self.begin = moves, stays, begin

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text a flag for each pattern: does the pattern fit all of it?"""
        rows = len(offsets) - 1
        out = np.zeros((rows, len(self.accept)), bool)
        step = max(1, STATE_BYTES // (8 * self.words))
        for low in range(0, rows, step):
            some = offsets[low : min(rows, low + step) + 1]
            state = self._states(data, some[:-1], np.diff(some))
            for k, (word, bit) in enumerate(self.accept):
                out[low : low + step, k] = (state[:, word] & bit) != 0
        return out

    def _states(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(-lengths, kind="stable")  # those still reading are a prefix
        starts, waiting = starts[order], -lengths[order]
        state = np.tile(self.begin, (len(order), 1))
        for t in range(-waiting[0] if len(order) else 0):
            reading = int(np.searchsorted(waiting, -t, side="left"))
            now = state[:reading]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            byte = data[starts[:reading] + t]
            state[:reading] = (shifted & self.moves[byte]) | (now & self.stays[byte])
        out = np.empty_like(state)
        out[order] = state
        return out


def _literal(text: str) -> list[int | None | str]:
    return list(text.encode("utf-8"))


def _glob(pattern: str) -> list[int | None | str]:
    wild = {ord("*"): "*", ord("?"): None}
    return [wild.get(b, b) for b in pattern.encode("utf-8")]


def _match(found: np.ndarray, order: Sequence[int]) -> np.ndarray:
    """Position of the first fitting pattern in ``order``, -1 if none fits."""
    out = np.full(len(found), -1)
    for k in reversed(order):
        out[found[:, k]] = k
    return out


def judge(
    df: DataFrame,
    rules: Sequence[Rule],
    globs: Sequence[Glob] = (),
    default: str = ALLOW,
    url: str = "url",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``glob`` and ``verdict`` to a table of URLs.

    The host runs from the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
    ASCII capitals lowered; the path up to ``?``, ``#`` or the end.  A null URL or one
    without ``://`` has both empty.  Of the fitting rules the longest (host and path
    together) decides, at equal length a blocking one, then the smaller name; without
    a rule the first fitting glob decides, blocking globs first, else ``default``.
    ``rule`` and ``glob`` are null where none fits.  URLs of any length are read whole,
    repeated rows stay, empty tables stay empty, clashing column names are replaced.
    """
    rules, globs = list(rules), list(globs)
    # One machine reads each address once: a rule's host ends at the break, globs do not see it.
    patterns = [["*", *_literal("." + r.host), BREAK, *_literal(r.path), "*"] for r in rules]
    patterns += [_glob(g.pattern) for g in globs]
    blocking = lambda x: x.verdict != BLOCK  # noqa: E731 - blocking ones sort first
    by_length = sorted(
        range(len(rules)), key=lambda k: (-len(rules[k].name), blocking(rules[k]), rules[k].name)
    )
    in_turn = sorted(range(len(globs)), key=lambda k: blocking(globs[k]))

    def make() -> ragged.Work:
        machine = Automaton(patterns, range(len(rules), len(patterns)))

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            found = machine.run(*ragged.flat(columns[0]))
            rule = _match(found[:, : len(rules)], by_length)
            glob = _match(found[:, len(rules) :], in_turn)
            verdicts = np.full(len(rule), default, object)
            for k, g in enumerate(globs):
                verdicts[glob == k] = g.verdict
            for k, r in enumerate(rules):
                verdicts[rule == k] = r.verdict
            names = np.array([*(r.name for r in rules), None], object)
            shapes = np.array([*(g.pattern for g in globs), None], object)
            return [pa.array(x, pa.string()) for x in (names[rule], shapes[glob], verdicts)]

        return work

    made = ("rule", "glob", "verdict")
    adds = T.StructType([T.StructField(c, T.StringType()) for c in made])
    taken = {"host", "path", *made}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    own = [f"k{i}" for i in range(len(kept))]
    host, path = host_of(F.col(ragged.quoted(url))), path_of(F.col(ragged.quoted(url)))
    address = F.concat(F.lit(b"."), host.cast("binary"), F.lit(bytes([BREAK])), path.cast("binary"))
    plain = df.select(
        *[F.col(ragged.quoted(c)).alias(n) for c, n in zip(kept, own, strict=True)],
        host.alias("host"),
        path.alias("path"),
        address.alias("address"),
    )
    judged = ragged.with_columns(plain, ["address"], adds, make, [*own, "host", "path"])
    return judged.toDF(*kept, "host", "path", *made)
