import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tallyglass.llm import bpe, token_counts
from tokenizers import Tokenizer

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = [
    "'", "'s", "'ll", "'re", "'ve", "'S", " ", "  ", "\n", "\t", "\u00a0", "a", "b", "the", "1",
    "23", "\u00b2", "\u00bd", "\u00e9", "e\u0301", "\u03a3", "\u0130", "\u00df", "\u6f22", "\U0001f600",
    "<|endoftext|>", "<|startoftext|>", "<|", "|>", "!", "...", "-", "_", "\u200b", "\u3000", "\x1c",
    "\x85", "\u01c5", "\ufb01", "\u2167", "\u0663", "\u0300", "aaaaaaa", "\ufeff", "\x00", "\u0131I",
]


def samples():
    random_texts = random.Random(1)
    texts = ["", " ", "\n\n", "ab" * 400, "a" * 301, "don't we'll 'tis", "x\n" * 30]
    for _ in range(1500):
        count = random_texts.randint(0, 40)
        texts.append("".join(random_texts.choice(PARTS) for _ in range(count)))
    for low in range(0, 0x2000, 32):
        letters = [chr(c) for c in range(low, low + 32)]
        texts += ["".join(letters), "x".join(letters), " ".join(f"a{c}'{c}s" for c in letters)]
    return texts


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    return path, Tokenizer.from_file(path)


def test_ids_and_texts_equal_the_library(both):
    path, library = both
    texts = samples()
    ids, offsets = bpe.encode_texts(path, texts)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expected
    decoded = bpe.Decoder(path).decode(ids.astype(np.int64), offsets).to_pylist()
    assert decoded == [library.decode(x, skip_special_tokens=False) for x in expected]
    assert token_counts.count_texts(path, texts).tolist() == [len(x) for x in expected]


def test_every_character_beside_others(both):
    """All code points next to a contraction, a letter, a number, a mark, spaces and breaks."""
    path, library = both
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = []
    for low in range(0, len(some), 512):
        for around in ("{0}'s a{0}1{0} {0}!{0}", "'{0} {0}\n{0}  {0}", "1{0}'s{0}'ll"):
            texts.append("|".join(around.format(c) for c in some[low : low + 512]))
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(path, texts).tolist() == expected
    assert [len(e) for e in np.split(*encoded(path, texts))] == expected


def encoded(path, texts):
    ids, offsets = bpe.encode_texts(path, texts)
    return ids, offsets[1:-1]


def test_long_texts_are_cut_where_a_token_begins(both, monkeypatch):
    path, library = both
    monkeypatch.setattr(bpe, "_LONG_TEXT", 50)
    text = "It's a  long text, isn't it? 12 345 \n\n x" * 20
    ids, _ = bpe.encode_texts(path, [text, "", text])
    once = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == once * 2
    assert token_counts.count_texts(path, [text]).tolist() == [len(once)]


def test_known_words_are_bounded(both, monkeypatch):
    path, library = both
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 2)
    words = bpe.Words(bpe.rules(path))
    monkeypatch.setitem(bpe._words, path, words)
    for text in ("one two three four", "two five six seven", "one two"):
        ids, _ = bpe.encode_texts(path, [text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_ordered_merging_when_rules_make_lower_ranks():
    # "abc" is made by rule 3, yet a rule of lower rank uses it.
    symbols = {s: i for i, s in enumerate(["a", "b", "c", "bc", "abc", "abca", "x"])}
    merges = [("b", "c"), ("abc", "a"), ("a", "bc")]
    pairs = bpe.Pairs(symbols, merges)
    assert not pairs.together
    word = np.array([symbols[s] for s in ["a", "b", "c", "a", "b", "c"]], np.int32)
    left, counts = pairs.merge(word, np.array([6]))
    assert left.tolist() == [symbols["abca"], symbols["bc"]] and counts.tolist() == [2]


def test_columns_nulls_and_empty_tables(both, make_docs):
    path, library = both
    docs = make_docs(["a dog", None, "", "a dog", "<|endoftext|>"], [1, 2, 3, 1, None])
    rows = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(rows) == 5 and set(rows[0].asDict()) == {*docs.columns, "decoded"}
    for row in rows:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert bytes(row["ids"]) == np.array(ids, "<u4").tobytes()
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), path).count() == 0
    counted = token_counts.count_tokens(docs, path, limit=1).collect()
    assert {(r["text"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counted} == {
        (t, len((t or "").encode()), n, n > 1)
        for t in ("a dog", None, "", "<|endoftext|>")
        for n in [len(library.encode(t or "", add_special_tokens=False).ids)]
    }
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_unknown_ids_are_skipped(both, spark):
    path, _ = both
    packed = np.array([1, 10**6, 2], "<u4").tobytes()
    frame = spark.createDataFrame([(packed,), (None,)], "ids binary")
    one = bpe.Decoder(path).decode(np.array([1, 2]), np.array([0, 2])).to_pylist()[0]
    assert {r["decoded"] for r in bpe.decode(frame, path).collect()} == {one, ""}


def test_query_digests(spark, sf_dir):
    from tallyglass.llm.queries import QUERIES

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op1_bpe_codec"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    json.dumps([r.asDict() for r in rows])


def test_count_query(spark, sf_dir):
    from tallyglass.llm.queries import QUERIES

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for row in QUERIES["op6_token_counts"](spark, sf_dir).collect():
        n = len(library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids)
        size = len((texts[row["doc_id"]] or "").encode())
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (size, n, n > 512)
