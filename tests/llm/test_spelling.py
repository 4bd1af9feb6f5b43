import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from tallyglass.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(counts):
    """The operator's rows from comparing all words."""
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(sorted(counts), 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def edited(r, word, letters):
    i = r.randrange(len(word) + 1)
    kind = r.randrange(3)
    if kind == 0:
        return word[:i] + r.choice(letters) + word[i:]
    return word[:i] + (r.choice(letters) if kind == 1 else "") + word[i + 1 :]


@pytest.mark.parametrize("seed", range(6))
def test_all_pairs(spark, seed):
    """Few letters make repeated bigrams and ties; a third of the words share a beginning."""
    r = random.Random(seed)
    letters = ["ab", "abc", "aé×ÿ", "abcdefghijklmnop", "a", "xyz"][seed]
    words = {"".join(r.choice(letters) for _ in range(r.randint(6, 11))) for _ in range(150)}
    words |= {"abababab" + w for w in list(words)[:60]}
    for _ in range(3):
        words |= {edited(r, w, letters) for w in list(words)[:150]}
    words = sorted(w for w in words if len(w) >= 6)
    counts = {w: int(5 * 3 ** r.uniform(0, 9)) for w in words}
    frame = spark.createDataFrame([(w, n, "k") for w, n in counts.items()], "word string, n long, key string")
    assert rows_of(spelling.variants(frame.repartition(3))) == plain(counts)


def test_chains_end_at_the_last_form(spark):
    chain = ["abcdefgh" + "z" * i for i in range(9)]
    counts = {w: 5 * 5**i for i, w in enumerate(chain)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.variants(frame))
    assert got == plain(counts) and {root for _, _, root, *_ in got} == {chain[-1]}


def test_pivots_are_the_lightest_pair():
    r = random.Random(2)
    for _ in range(500):
        places = sorted(r.sample(range(15), r.randint(3, 9)))
        weights = [r.randint(1, 6) for _ in places]
        weight = dict(zip(places, weights, strict=True))
        pairs = [weight[a] + weight[b] for a, b in itertools.combinations(places, 2) if b - a >= 2]
        a, b = spelling.pivots(places, weights)
        assert b - a >= 2 and weight[a] + weight[b] == min(pairs)


def words_of(docs, every):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return counts


def test_words(spark, make_docs):
    texts = [
        None, "", "abcde", "abcdef ABCDEF ÀÉÎÕÜß àéîõüß", "x" * 100_000 + " Straße-straßen'straßen",
        "Ωmega omegaΩomegaa ×÷×÷×÷×", "word1words", "abcdefg " * 3000, "abcdef", "abcdef",
    ]
    for every in (None, 2, 199):
        docs = make_docs(texts, ids=[None, 1, 2, 3, 4, 5, 6, 7, 8, 8])
        got = {r["word"]: r["n"] for r in spelling.word_counts(docs, every=every).collect()}
        assert got == words_of(zip([None, 1, 2, 3, 4, 5, 6, 7, 8, 8], texts, strict=True), every)
    assert spelling.variants(spelling.frequent_words(make_docs([None, ""]))).count() == 0
    assert spelling.variants(spelling.frequent_words(make_docs(["one word"]).limit(0))).count() == 0


def test_very_long_words(spark):
    """A word of one letter has all its bigrams tied."""
    counts = {"a" * 5000: 50, "a" * 5001: 5, "a" * 2500 + "b" + "a" * 2499: 7, "ab" * 3000: 9}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(frame)) == plain(counts)


def test_query(spark, sf_dir):
    from tallyglass.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    counts = {w: n for w, n in words_of(docs, 199).items() if n >= 5}
    assert rows_of(QUERIES["op12_spelling"](spark, sf_dir)) == plain(counts)
