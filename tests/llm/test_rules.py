"""URL rules, quality rules and licences against plain Python."""

import random
import re
from collections import Counter
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyglass.llm import license_scan, quality_rules, ragged, url_filter
from tallyglass.llm.queries import QUERIES, URL_GLOBS, URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def judged(url):
    match = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = match.groups() if match else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        r for r in URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    if fits:
        rule = max(fits, key=lambda r: len(r.name))
        return host, path, rule.name, rule.verdict
    hit = any(fnmatchcase(f".{host}{path}", g.pattern) for g in URL_GLOBS)
    return host, path, None, "block" if hit else "allow"


def test_urls(spark, sf_dir):
    urls = [
        None, "", "no address", "http://example.net", "http://EXAMPLE.net/en/x?y#z", "ftp://a.net/",
        "http://b.example.com/de/1", "http://example.com/de", "http://notexample.com/de/",
        "http://x.org/fr/", "http://x.org:80/fr/", "://", "a://b://c/net/", "http://net/", "http://cnet/",
        "http://q.com/" + "spam" * 3000, "http://q.com/a.cheap-b/", "HTTP://CHEAP-x.com", "http://n\u00e4t/\n/x",
    ]
    urls += [r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    frame = spark.createDataFrame(
        [(i, u, "r", "h") for i, u in enumerate(urls)], "page_id long, url string, Rule string, host string"
    )
    rows = url_filter.judge(frame, URL_RULES, URL_GLOBS).collect()
    assert len(rows) == len(urls) and "Rule" not in rows[0].asDict()
    for row in rows:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == judged(row["url"])
    assert url_filter.judge(frame.limit(0), URL_RULES).count() == 0
    plain = url_filter.judge(frame, [], [], default="block").select("verdict").distinct().collect()
    assert [r[0] for r in plain] == ["block"]


def test_automaton_against_fnmatch():
    random_texts = random.Random(3)
    patterns = ["".join(random_texts.choice("ab?*") for _ in range(n % 9)) for n in range(60)]
    texts = ["".join(random_texts.choice("abc") for _ in range(n % 12)) for n in range(300)]
    machine = url_filter.Automaton([url_filter._glob(p) for p in patterns])
    assert machine.words > 1
    found = machine.run(*ragged.flat(pa.array(texts)))
    expected = [[fnmatchcase(t, p) for p in patterns] for t in texts]
    assert found.tolist() == expected


def test_rules_and_globs_are_one_machine(spark):
    """Many rules and globs over several words of state; globs run across host and path."""
    random_urls = random.Random(8)
    hosts = [f"{a}.{b}" for a in ("a", "bb", "c-d") for b in ("net", "org", "example.com")]
    rules = [
        url_filter.Rule(random_urls.choice(["block", "allow"]), h, p)
        for h in hosts for p in ("/", "/x/", "/x/y")
    ]
    globs = [
        url_filter.Glob(v, g)
        for v, g in [("block", "*.zz/q*"), ("allow", "*z?q*"), ("block", "*\u00e4?*"), ("block", "*.io"), ("block", "*")]
    ]
    urls = [
        f"http://{random_urls.choice(['', 'w.', 'xa.'])}{random_urls.choice([*hosts, 'h.zz', 'k.io', '\u00e4b'])}"
        f"{random_urls.choice(['', '/', '/x', '/x/', '/x/y', '/x/yz', '/q', '/.a.net/x/'])}"
        for _ in range(400)
    ]
    frame = spark.createDataFrame([(i, u, "h", "b") for i, u in enumerate(urls)], "page_id long, url string, _host string, _both string")
    for row in url_filter.judge(frame, rules, globs).collect():
        match = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", row["url"])
        host, path = match.groups()
        fits = [r for r in rules if f".{host}".endswith(f".{r.host}") and path.startswith(r.path)]
        best = min(fits, key=lambda r: (-len(r.name), r.verdict != "block", r.name), default=None)
        hits = [g for g in globs if fnmatchcase(f".{host}{path}", g.pattern)]
        glob = min(hits, key=lambda g: g.verdict != "block")
        assert (row["rule"], row["glob"]) == (best and best.name, glob.pattern)
        assert row["verdict"] == (best or glob).verdict and row["_host"] == "h"


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(text.count(c) for c in quality_rules.SYMBOLS)
    chars = sum(map(len, words))
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def test_measurements(make_docs):
    random_texts = random.Random(5)
    parts = ["a", "b", "\u00e9\u00e9", " ", "\n", "\t", "#", "\u00a0", "|", "x y\n", "\x0b"]
    texts = ["", None, "a", "a b c d a b c", "x\nx\n\n \nx", "a a a a", "\n", "\u6f22 " * 3000]
    texts += ["".join(random_texts.choice(parts) for _ in range(n)) for n in range(80)]
    rows = quality_rules.ledger(make_docs(texts)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert tuple(row[m] for m in quality_rules.MEASURES) == measured(row["text"])
    assert quality_rules.ledger(make_docs(texts).limit(0)).count() == 0


def thue_morse(size, a, b):
    """A sequence that collides with its complement under any polynomial hash modulo 2**64."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(size))


@pytest.mark.parametrize("size", [1024, 2048, 8192])
def test_constructed_words_and_lines_are_told_apart(make_docs, size):
    x, y = thue_morse(size, "p", "q"), thue_morse(size, "q", "p")
    texts = [f"{x}\n{y}", f"A {x} B {y} C", f"A {x} y B z A {y} y B", f"{x}\n{x}"]
    for row in quality_rules.ledger(make_docs(texts)).collect():
        assert tuple(row[m] for m in quality_rules.MEASURES) == measured(row["text"])
    words = ragged.flat(pa.array([x + " " + y]))
    spans = ragged.word_spans(*words, ragged.letter_bytes())[:2]
    assert len(set(ragged.span_hashes(words[0], *spans).tolist())) == 2
    phrase = license_scan.Template("x", f"a {x} b", True)
    found = license_scan.scan(make_docs([f"a {y} b", f"a {x} b"]), [phrase]).collect()
    assert {r["doc_id"]: r["n_base"] for r in found} == {0: 0, 1: 1}


def test_repeated_lines_are_set_against_lines(make_docs):
    """Ten different words a line, four lines in ten repeated."""
    line = lambda n: " ".join(f"w{n}x{k}" for k in range(10))
    docs = make_docs(["\n".join(line(n % 24) for n in range(40)), "\n".join(map(line, range(40)))])
    rows = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    assert rows[0]["n_dup_lines"] == 16 and rows[0]["n_lines"] == 40
    assert rows[0]["failed_bits"] & quality_rules.bit("repeated_lines")
    assert rows[1]["failed_bits"] == 0


def test_policies_and_ablations(spark):
    bit = quality_rules.bit
    few, repeated, symbols = bit("few_words"), bit("repeated_words"), bit("many_symbols")
    ledger = spark.createDataFrame(
        [(0,), (few,), (few | repeated,), (symbols,), (symbols,)], "failed_bits long"
    )
    rejected = ledger.where(quality_rules.fails("base")).count()
    assert rejected == 2 and ledger.where(quality_rules.fails("2")).count() == 4
    rows = quality_rules.ablations(ledger, {"base": quality_rules.POLICIES["base"]}).collect()
    found = {r["rule"]: (r["failed"], r["only"], r["rejected"]) for r in rows}
    assert found == {"few_words": (2, 1, 2), "repeated_words": (1, 0, 2)}


def licensed(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for template in license_scan.PHRASES:
        phrase = template.words.split()
        for i in range(len(words)):
            if words[i : i + len(phrase)] == phrase:
                places.append(i)
                labels.add(template.label)
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(labels))


def test_licences(spark, sf_dir, make_docs):
    notice = license_scan.NOTICES[3].words
    inserted = notice.replace("applicable law", "any applicable written law")
    texts = [
        None, "", "MIT License", "mit  license; CC-BY. the Apache\nLicense, apache license", "x " * 500,
        "GNU General Public License " * 400, notice, inserted, "cc", "license mit license license",
        "apache unless required", "\u00e9cc by", "gnu general general public license",
    ]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = license_scan.scan(make_docs(texts, parts=4)).collect()
    assert len(rows) == len(texts)
    by_id = {r["doc_id"]: r for r in rows}
    for i, text in enumerate(texts):
        row = by_id[i]
        found = tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))
        assert found == licensed(text), text
        assert 0 <= row["score"] <= 1
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
    for i in (6, 7):
        assert by_id[i]["labels"] == "apache" and by_id[i]["base_labels"] == ""
    assert by_id[10]["labels"] == ""
    assert license_scan.scan(make_docs(texts).limit(0)).count() == 0
    repeated = make_docs(["mit license", "mit license"], [None, None])
    assert [r["n_base"] for r in license_scan.scan(repeated).collect()] == [1, 1]


def test_spans_lie_inside_the_text(spark):
    """A span without the template's first words begins at the first word there is."""
    texts = ["under the apache license version 2 0", "see licensed under the apache license version 2 0 now"]
    frame = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, _words int")
    rows = {r["doc_id"]: r for r in license_scan.scan(frame, keep=("doc_id", "_words")).collect()}
    spans = {i: [(s["label"], s["first_word"], s["last_word"], round(s["coverage"], 3)) for s in r["spans"]] for i, r in rows.items()}
    assert spans[0] == [("apache", 0, 6, 0.857), ("apache", 2, 3, 1.0)]
    assert spans[1] == [("apache", 1, 8, 1.0), ("apache", 4, 5, 1.0)]
    assert all(r["_words"] == 7 and r["score"] == 1.0 for r in rows.values())
    assert {i: r["n_words"] for i, r in rows.items()} == {0: 7, 1: 10}


def plain_labels(text):
    """All labels and the score, from plain Python over every place of every template."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best = set(), 0.0
    for t in license_scan.PHRASES + license_scan.NOTICES:
        own = t.words.split()
        pairs = list(zip(own, own[1:]))
        hits = Counter()
        places = {}
        for at, pair in enumerate(zip(words, words[1:])):
            for place, wanted in enumerate(pairs):
                if pair == wanted:
                    places.setdefault(at - place, set()).add(place)
        for diagonal in sorted(places):
            hits[diagonal] = len(places[diagonal])
        groups = []
        for diagonal in sorted(places):
            if t.exact or not groups or diagonal - groups[-1][-1] > license_scan.NEAR:
                groups.append([])
            groups[-1].append(diagonal)
        for group in groups:
            together = len(set().union(*(places[d] for d in group)))
            if 2 * (group[-1] - group[0]) > len(own):
                together = max(hits[d] for d in group)
            share = together / len(pairs)
            best = max(best, share)
            if share >= (1 if t.exact else license_scan.LEAST_COVERAGE):
                labels.add(t.label)
    return ",".join(sorted(labels)), best


def test_labels_and_scores_against_all_places(spark, sf_dir, make_docs):
    random_words = random.Random(12)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for t in license_scan.NOTICES:
        own = t.words.split()
        for _ in range(6):
            some = [w for w in own if random_words.random() < 0.93]
            for _ in range(random_words.randrange(3)):
                some.insert(random_words.randrange(len(some) + 1), random_words.choice(["the", "any", "zebra"]))
            texts.append("Some words first. " + " ".join(some) + " and then others")
    rows = license_scan.scan(make_docs(texts, parts=4)).collect()
    for r in rows:
        labels, best = plain_labels(texts[r["doc_id"]])
        assert (r["labels"], round(r["score"], 9)) == (labels, round(best, 9)), texts[r["doc_id"]][:200]
    assert len({r["labels"] for r in rows}) > 10


def test_word_spans_stop_at_rows():
    data, offsets = ragged.flat(pa.array(["ab", "", None, "cd e", "f"]))
    starts, ends, first = ragged.word_spans(data, offsets, ragged.letter_bytes())
    assert list(zip(starts.tolist(), ends.tolist())) == [(0, 2), (2, 4), (5, 6), (6, 7)]
    assert first.tolist() == [0, 1, 1, 1, 3, 4]
    hashes = ragged.span_hashes(np.concatenate((data, data)), starts, ends)
    assert len(set(hashes.tolist())) == 4


def test_url_query_counts(spark, sf_dir):
    rows = QUERIES["op2_url_filter"](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert rows.where(F.col("verdict").isin("block", "allow")).count() == rows.count()
