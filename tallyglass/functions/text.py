"""Expressions over a text column: hashes, line counts, patterns, tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode classes spelled out, so that every regex engine agrees on them:
# word characters are letters, numbers and underscore; blanks include the
# information separators and all Unicode spaces.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
BLANK = r"[\t-\r\x1c-\x1f\x85\p{Z}]"

# Security patterns and their messages (fixed values, in report order), with
# literals of which a match contains at least one.
SECURITY_PATTERNS = [
    (rf"(?<!{WORD})eval{BLANK}*\(", "Use of eval() is dangerous", ["eval"]),
    (rf"(?<!{WORD})exec{BLANK}*\(", "Use of exec() is dangerous", ["exec"]),
    (
        rf"pickle\.loads?{BLANK}*\(",
        "Pickle deserialization can be unsafe",
        ["pickle.load"],
    ),
    (
        rf"subprocess\.{WORD}+\(.*shell=True",
        "Shell injection vulnerability possible",
        ["subprocess."],
    ),
    (
        rf"os\.system{BLANK}*\(",
        "os.system() can be vulnerable to injection",
        ["os.system"],
    ),
    (rf"__import__{BLANK}*\(", "Dynamic imports can be risky", ["__import__"]),
    (
        rf"(password|secret|token|key){BLANK}*={BLANK}*[\"'].*[\"']",
        "Hardcoded credentials detected",
        ["password", "secret", "token", "key"],
    ),
    (r"http://", "Using HTTP instead of HTTPS", ["http://"]),
    (
        r"\.format\(.*request\.|f[\"'].*request\.",
        "Possible format string vulnerability",
        ["request."],
    ),
]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def stripped(text: Column) -> Column:
    """Text without leading and trailing blanks of any kind."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor comments."""

    def is_code(line: Column) -> Column:
        return line.rlike(rf"\A{BLANK}*[^\t-\r\x1c-\x1f\x85\p{{Z}}#]")

    return F.size(F.filter(lines(text), is_code))


def comment_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda line: line.rlike(rf"\A{BLANK}*#")))


def comment_ratio(text: Column) -> Column:
    """Comment lines over all lines, blank ones included."""
    return comment_lines(text) / F.greatest(F.size(lines(text)), F.lit(1))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


# Letters that ignore-case matching equates to an ASCII letter but lower case
# does not (fixed values).
_ALIKE = {"\u0130": "i", "\u0131": "i", "\u017f": "s"}


def _folded(text: Column) -> Column:
    """Lower case in which letters that ignore-case matching equates look the same."""
    for letter, plain in _ALIKE.items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def security_issues(
    text: Column, patterns: list[tuple[str, str, list[str]]] = SECURITY_PATTERNS
) -> Column:
    """Messages of all patterns found anywhere in the text, ignoring case.

    A pattern is only tried on texts that contain one of its literals; a pattern
    without literals is always tried.
    """

    def found(folded: Column) -> Column:
        messages = []
        for pattern, message, literals in patterns:
            match = F.when(text.rlike("(?idu)" + pattern), F.lit(message))
            if literals:
                possible = F.lit(False)
                for literal in literals:
                    possible = possible | folded.contains(literal)
                match = F.when(possible, match)
            messages.append(match)
        return F.array(*messages)

    return F.filter(bind(_folded(text), found), lambda m: m.isNotNull())


def repeated_line(text: Column, shorter_than: int = 21, copies: int = 3) -> Column:
    """1-based number of the first long line that occurs ``copies`` times, or null.

    Lines are sorted inside the row, so equal lines stand next to each other and
    no line leaves its row.
    """

    def is_long(line: Column) -> Column:
        return F.length(line) >= shorter_than

    numbered = F.transform(lines(text), lambda line, i: F.struct(line.alias("line"), i.alias("at")))
    long_ones = F.filter(
        numbered, lambda x: is_long(x["line"]) & is_long(stripped(x["line"]))
    )

    def first(ordered: Column) -> Column:
        later = F.slice(ordered, F.lit(copies), F.greatest(F.size(ordered), F.lit(1)))
        pairs = F.arrays_zip(ordered.alias("a"), later.alias("b"))
        matches = F.filter(pairs, lambda p: p["a"]["line"] == p["b"]["line"])
        return F.array_min(F.transform(matches, lambda p: p["a"]["at"])) + 1

    return bind(F.sort_array(long_ones), first)


def tokens(text: Column, max_chars: int | None = None) -> Column:
    """Words and single other characters; the whole text unless a cut is given."""
    used = text if max_chars is None else F.substring(text, 1, max_chars)
    return F.regexp_extract_all(used, F.lit(rf"({WORD}+|{NOT_WORD})"), F.lit(1))


def _runs(
    ordered: Column,
    same: Callable[[Column, Column], Column],
    pack: Callable[[Column, Column], Column],
) -> Column:
    """``pack(first, end)`` of every run of equal neighbours in a bound array."""
    size = F.size(ordered)
    starts = F.filter(
        F.sequence(F.lit(0), size),
        lambda i: (i < size) & ((i == 0) | ~same(F.get(ordered, i), F.get(ordered, i - 1))),
    )

    def spans(begin: Column) -> Column:
        ends = F.concat(F.slice(begin, F.lit(2), F.size(begin)), F.array(size))
        return F.zip_with(begin, F.slice(ends, F.lit(1), F.size(begin)), pack)

    return bind(starts, spans)


def token_counts(text: Column, max_chars: int | None = None) -> Column:
    """Distinct tokens of a text with their counts; nothing leaves the row."""

    def count(ordered: Column) -> Column:
        return _runs(
            ordered,
            lambda a, b: a == b,
            lambda first, end: F.struct(
                F.get(ordered, first).alias("token"), (end - first).alias("n")
            ),
        )

    return bind(F.sort_array(tokens(text, max_chars)), count)


def token_bucket(token: Column, buckets: int = 10_000) -> Column:
    """A stable bucket of a token."""
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def hmac_sha256(secret: str, message: Column) -> Column:
    """Keyed hash of a string column in built-in expressions (RFC 2104), as hex."""
    key = secret.encode()
    if len(key) > 64:  # longer than a block: the key is the secret's digest
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    digest = F.sha2(F.concat(inner, message.cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)
