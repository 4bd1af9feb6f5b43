import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tallyglass.llm import periodic_runs, ragged
from tallyglass.llm.periodic_runs import Suffixes, WaveletTree, find_runs


def brute_runs(words):
    """Every maximal run by trying all periods, smallest first."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def samples(seed):
    r = random.Random(seed)
    kind = seed % 5
    if kind == 0:
        return [r.randint(0, 1) for _ in range(r.randint(0, 120))]
    if kind == 1:
        return [0] * r.randint(0, 70)
    if kind == 2:  # a repeated root with noise at both ends
        root = [r.randint(0, 2) for _ in range(r.randint(1, 20))]
        body = root * r.randint(1, 9) + root[: r.randint(0, len(root))]
        return [r.randint(0, 2) for _ in range(r.randint(0, 9))] + body + [r.randint(0, 2) for _ in range(5)]
    if kind == 3:  # roots that are nearly of one symbol
        root = [0] * r.randint(1, 30) + [1]
        return (root * r.randint(3, 7))[r.randint(0, 3) :]
    a = [0] * r.randint(1, 6) + [1]
    inner = a * r.randint(1, 5) + [r.randint(0, 2)]
    return inner * r.randint(3, 6) + [0] * r.randint(0, 8)


def test_runs_equal_all_periods():
    rows = [samples(seed) for seed in range(600)]
    offsets = ragged.offsets_of(np.array([len(x) for x in rows]))
    flat = np.array([s for x in rows for s in x], np.int64)
    start, end, period = find_runs(flat, offsets)
    of = np.searchsorted(offsets, start, side="right") - 1
    got = [[] for _ in rows]
    for row, s, e, q in zip(of.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        got[row].append((s - int(offsets[row]), e - s, q))
    assert sum(map(len, got)) > 200
    for row, found in zip(rows, got, strict=True):
        assert found == brute_runs(row), row


@pytest.mark.parametrize("root", range(1, 70))
def test_every_period_is_found_wherever_it_starts(root):
    r = random.Random(root)
    for lead in range(0, 40, 3):
        word = [r.randint(0, 1 + root % 3) for _ in range(root)]
        row = [9 + i for i in range(lead)] + word * 4 + [99]
        row += [7] * (root == 1) * 2
        if root == 1:
            row = [9 + i for i in range(lead)] + word * 6
        start, end, period = find_runs(np.array(row), np.array([0, len(row)]))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == brute_runs(row)


def test_suffixes_and_ranges():
    r = np.random.default_rng(1)
    offsets = np.array([0, 0, 7, 40, 41, 100])
    symbols = r.integers(0, 2, 100)
    suffixes = Suffixes(symbols, offsets)
    row_end = lambda i: offsets[np.searchsorted(offsets, i, side="right")]
    keys = [(np.searchsorted(offsets, i, side="right"), symbols[i : row_end(i)].tolist()) for i in range(100)]
    assert suffixes.order.tolist() == sorted(range(100), key=keys.__getitem__)
    values = r.permutation(77)
    tree = WaveletTree(values)
    low = r.integers(0, 77, 200)
    high = np.minimum(77, low + r.integers(1, 40, 200))
    limit = r.integers(0, 140, 200)
    assert tree.below(low, high, limit).tolist() == [
        int((values[a:b] < c).sum()) for a, b, c in zip(low, high, limit, strict=True)
    ]
    nth = r.integers(0, high - low)
    assert tree.nth(low, high, nth).tolist() == [
        int(np.sort(values[a:b])[c]) for a, b, c in zip(low, high, nth, strict=True)
    ]


def expected(doc_id, text):
    """The row of the query, from plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if n and not rest:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
    return (doc_id, len(runs), *longest, sha(lines), sha(kept))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_texts(spark, make_docs):
    texts = [
        None, "", " \t\n", "a", "a a a a a a", "a a a a a", "x\x0ba\x1ca b é é é é é é é",
        "a b " * 300, "a b a b a b a b c " * 40, "ab a b " * 9 + "z", "w " * 20_000,
        " ".join(str(i) for i in range(3000)) + " go stop" * 500, "a a a a a a", "a a a a a a",
    ]
    docs = make_docs(texts)
    found = periodic_runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "score", "ids", "Row", "key", "n_words", "runs", "collapsed"]
    plain = {r["doc_id"]: r for r in found.collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words) if len(words) < 5000 else [(0, 20_000, 1)]
        assert [tuple(x) for x in plain[i]["runs"]] == runs and plain[i]["n_words"] == len(words)
    assert plain[10]["collapsed"] == "w" and plain[0]["collapsed"] == ""
    assert plain[11]["collapsed"].endswith("2999 go stop")
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert periodic_runs.with_repeats(make_docs(["a b c d"], ids=[None])).first()["text"] == "a b c d"


def test_query(spark, sf_dir):
    from tallyglass.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    docs = [d for d in docs if len(d["text"] or "") < 40_000]
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    for d in docs:
        assert rows[d["doc_id"]] == expected(d["doc_id"], d["text"])
    assert sum(r[1] > 0 for r in rows.values()) > 15


def test_many_words_at_once():
    """Ranks of more than 2**16 words."""
    r = np.random.default_rng(4)
    symbols = np.concatenate((r.integers(0, 50, 150_000), np.tile(r.integers(0, 9, 5_000), 5)))
    start, end, period = find_runs(symbols, np.array([0, len(symbols)]))
    assert (150_000 - 20 <= start[period == 5_000]).all() and 5_000 in period.tolist()
    assert len(Suffixes(symbols, np.array([0, len(symbols)])).classes) < 17
