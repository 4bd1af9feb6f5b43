"""Exact and near de-duplication against plain Python, with hot groups and odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from check import TABLES, plain
from pyspark.sql import functions as F
from tallyglass.llm import dart_minhash, exact_dedup, near_dups, ragged
from tallyglass.llm.queries import ORACLES, QUERIES

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected_groups(rows):
    """Per row (id, text): the id that stays, the group's size, the digest."""
    groups = defaultdict(list)
    for place, (i, text) in enumerate(rows):
        body = SPACE.sub("", text or "")
        groups[body].append((-len(text or ""), i is None, i, place))
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[2], best[2], len(members), digest) for m in members]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def copies():
    random_texts = random.Random(8)
    texts = [None, "", " \n", "a b", "ab", "a  b", "A b", " ", "ab\x0b", "x" * 100_000, "x " * 100_000]
    texts += ["".join(random_texts.choice("ab \n") for _ in range(n % 7)) for n in range(200)]
    texts += ["hot text"] * 150 + ["hottext"] * 20
    ids = [*range(len(texts) - 4), 5, 5, None, None]
    random_texts.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def weak(body):
    """A digest with many collisions."""
    return F.unhex(F.substring(F.md5(body), 1, 1))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_exact_groups(make_docs, copies, digest, files_per_batch, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COPIES_PER_TASK", 7)
    docs = make_docs([t for _, t in copies], [i for i, _ in copies], parts=4)
    rows = exact_dedup.dedup(docs, files_per_batch=files_per_batch, digest=digest).collect()
    wanted = expected_groups(copies)
    if digest is exact_dedup.sha256:
        found = [(r["id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in rows]
        assert sorted(found, key=str) == wanted
    else:
        found = [(r["id"], r["keep_id"], r["group_size"]) for r in rows]
        assert sorted(found, key=str) == sorted((w[:3] for w in wanted), key=str)
    assert sum(r["kept"] for r in rows) == len({w[3] for w in wanted})


def test_kept_documents_have_all_columns(make_docs, copies):
    docs = make_docs([t for _, t in copies], [i for i, _ in copies])
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    bodies = [SPACE.sub("", r["text"] or "") for r in kept.collect()]
    assert len(bodies) == len(set(bodies)) == len({SPACE.sub("", t or "") for _, t in copies})
    empty = docs.limit(0)
    assert exact_dedup.without_copies(empty).count() == exact_dedup.dedup(empty).count() == 0


def test_without_broadcast_of_the_copies(make_docs, copies, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SMALL_ROWS", 0)
    docs = make_docs([t for _, t in copies], [i for i, _ in copies])
    rows = exact_dedup.dedup(docs).collect()
    found = [(r["id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in rows]
    assert sorted(found, key=str) == expected_groups(copies)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    rows = df.select(*names).collect()
    theirs = sorted(str(tuple(plain(v) for v in r)) for r in result.fetchall())
    assert sorted(str(tuple(plain(v) for v in r)) for r in rows) == theirs


def shingled(text, size=5):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def expected_classes(texts, least=0.8):
    """Index of the first text of each text's class, from all pairs."""
    sets = [shingled(t) for t in texts]
    first = list(range(len(texts)))

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            same = sets[a] == sets[b] or shared >= least * (len(sets[a]) + len(sets[b]) - shared)
            if same and (sets[a] or not sets[b]):
                x, y = root(a), root(b)
                first[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(texts))]


def near_texts():
    """Chains, a large group of edited copies, exact copies, shared passages, odd texts."""
    random_texts = random.Random(11)
    word = lambda: "".join(random_texts.choice("abcdefgh") for _ in range(4))
    texts = [None, "", "...", "one", "One!", "one two", "one two three", "one two three"]
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    for n in range(60):  # edited at one or two places
        copy = list(base)
        for _ in range(n % 3):
            copy[random_texts.randrange(120)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for _ in range(25):  # every copy is like the one before, the ends have little in common
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    for n in range(60):  # a shared passage alone is no copy, however long
        texts.append(" ".join(passage + [word() for _ in range(60 if n % 2 else 12)]))
    texts += [texts[20].upper() + "."] * 5 + [" ".join(["same"] * 50)] * 2
    return texts


@pytest.mark.parametrize("broadcast, crowd", [(True, 32), (False, 2)])
def test_near_classes(make_docs, broadcast, crowd, monkeypatch):
    monkeypatch.setattr(near_dups, "CROWD", crowd)
    if not broadcast:
        monkeypatch.setattr(near_dups, "_MOST_BROADCAST", 0)
    texts = near_texts()
    ids = [1000 - i for i in range(len(texts))]
    rows = near_dups.near_duplicates(make_docs(texts, ids)).collect()
    assert len(rows) == len(texts)
    members = defaultdict(set)
    for i, first in enumerate(expected_classes(texts)):
        members[first].add(ids[i])
    wanted = {i: (min(group), len(group)) for group in members.values() for i in group}
    assert {r["id"]: (r["class_id"], r["class_size"]) for r in rows} == wanted
    assert {r["id"] for r in rows if r["kept"]} == {c for c, _ in wanted.values()}


def test_bitmaps_never_exclude_a_similar_pair(spark):
    """Sets of many sizes, among them on both sides of a change of width."""
    random_sets = np.random.default_rng(9)
    sets, pairs = [], []
    for n, size in enumerate([1, 2, 5, 9, 40, 300, 900, 1300, 1366, 1400, 2500, 5600, 9000]):
        own = random_sets.choice(2**62, size * 2, replace=False)
        for step, share in enumerate([1.0, 0.9, 0.89, 0.85, 0.5, 0.0]):
            same = round(size * share)
            members = np.concatenate((own[:same], own[size : 2 * size - same])).astype(np.uint64)
            sets.append((10 * n + step, np.sort(members)))
        pairs += [(10 * n + a, 10 * n + b) for a in range(6) for b in range(a + 1, 6)]
    rows = []
    for node, members in sets:
        bits, cuts = near_dups.bitmaps(members, np.array([0, len(members)]))
        assert len(bits) == cuts[1] and len(bits) * 64 >= 0.75 * len(members)
        rows.append((node, members.astype(np.int64).tolist(), [1] * len(members), bits.tolist()))
    frame = spark.createDataFrame(rows, "node long, items array<long>, times array<int>, bits array<long>")
    asked = spark.createDataFrame(pairs, "a long, b long")
    settings = near_dups.Settings()
    of = {node: set(members.tolist()) for node, members in sets}
    similar = {(a, b) for a, b in pairs if len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]) - 1e-12}
    possible = {tuple(r) for r in near_dups._possible(asked, frame, settings).collect()}
    assert similar <= possible and len(possible) < len(pairs) * 0.75
    assert {tuple(r) for r in near_dups._similar(asked, frame, settings).collect()} == similar


def test_constructed_words_make_no_copies(make_docs):
    """Words that collide under polynomial hashes modulo 2**64 are different words."""
    x = "".join("pq"[bin(i).count("1") % 2] for i in range(4096))
    y = "".join("qp"[bin(i).count("1") % 2] for i in range(4096))
    rows = near_dups.near_duplicates(make_docs([x, y, f"{x} a b c d", f"{y} a b c d"])).collect()
    assert all(r["class_size"] == 1 for r in rows)


def test_near_repeated_and_missing_ids(make_docs):
    long = " ".join(f"w{i}" for i in range(5000))
    texts = [long, long + " more", long, "other words here", None]
    docs = make_docs(texts, [4, None, 4, None, None])
    rows = near_dups.near_duplicates(docs).collect()
    assert sorted((r["class_id"] or 0, r["class_size"]) for r in rows) == [(0, 1)] * 2 + [(4, 3)] * 3
    kept = near_dups.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0
    assert near_dups.one_of_each(docs.limit(0)).count() == 0


def test_counted_shingles_weigh_repeats(make_docs):
    line = "the same five words again "
    texts = [line * 10, line * 11, line * 40]
    settings = near_dups.Settings(counted=True)
    rows = {r["id"]: r["class_id"] for r in near_dups.near_duplicates(make_docs(texts), settings=settings).collect()}
    assert rows == {0: 0, 1: 0, 2: 2}
    rows = {r["id"]: r["class_id"] for r in near_dups.near_duplicates(make_docs(texts)).collect()}
    assert rows == {0: 0, 1: 0, 2: 0}


def test_classes_merge_along_long_chains(spark):
    numbers = list(range(300))
    random.Random(1).shuffle(numbers)
    classes = spark.createDataFrame([(n, n) for n in numbers], "node long, class long")
    links = spark.createDataFrame(
        [(numbers[i], numbers[i + 1]) for i in range(199)] + [(numbers[i], numbers[250]) for i in range(251, 290)],
        "u long, v long",
    )
    merged = dict(near_dups._merge(classes, links).collect())
    for group in (numbers[:200], numbers[250:290]):
        assert {merged[n] for n in group} == {min(group)}
    assert all(merged[n] == n for n in [*numbers[200:250], *numbers[290:]])


def test_signatures_estimate_weighted_similarity():
    random_sets = np.random.default_rng(5)
    agree, exact = [], []
    for _ in range(60):
        elements = random_sets.integers(1, 2**63, 40).astype(np.uint64)
        a = random_sets.uniform(0.1, 9, 40)
        b = a * random_sets.choice([1, 0.5, 2], 40)
        both = dart_minhash.signatures(
            np.concatenate((elements, elements)), np.concatenate((a, b)), np.array([0, 40, 80]), 160
        )
        agree.append((both[0] == both[1]).mean())
        exact.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert (both != 0).all()
    assert abs(np.mean(agree) - np.mean(exact)) < 0.02


def test_signatures_do_not_depend_on_the_batch():
    random_sets = np.random.default_rng(6)
    sizes = [0, 1, 3, 400, 0, 7]
    offsets = ragged.offsets_of(np.array(sizes))
    elements = random_sets.integers(1, 2**63, offsets[-1]).astype(np.uint64)
    weights = np.ones(len(elements))
    together = dart_minhash.signatures(elements, weights, offsets, 32)
    for row, (a, b) in enumerate(zip(offsets, offsets[1:])):
        alone = dart_minhash.signatures(elements[a:b], weights[a:b], np.array([0, b - a]), 32)
        assert (alone[0] == together[row]).all()
        assert (together[row] == 0).all() == (sizes[row] == 0)


def test_state_stores_are_closed_with_their_tasks(spark):
    session = exact_dedup._stream_session(spark)
    assert session.conf.get("spark.sql.streaming.stateStore.unloadOnCommit") == "true"
    assert spark.conf.get("spark.sql.streaming.stateStore.unloadOnCommit", "false") == "false"
