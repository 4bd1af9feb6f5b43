import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tallyglass.llm import packing
from tokenizers import Tokenizer


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def documents():
    random_ids = random.Random(2)
    rows = [(i, [random_ids.randint(3, 9) for _ in range(random_ids.choice([0, 1, 5, 40, 200, 700]))])
            for i in range(400)]
    return [*rows, (7, [4] * 63), (7, [4] * 63), (None, []), (900, [5] * 64 * 7)]


def rebuilt(rows, window):
    """Documents by (id, tokens) from the pieces, checking every sequence."""
    by_sequence, by_document = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_document.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    return by_sequence, by_document


def test_every_id_is_packed_once(spark, documents):
    window = 64
    frame = spark.createDataFrame(
        [(i, packed(x), "s") for i, x in documents] + [(901, None, "s")],
        "doc_id long, ids binary, start string",
    ).repartition(3)
    rows = packing.pack(frame, window=window).collect()
    by_sequence, by_document = rebuilt(rows, window)
    for (doc_id, tokens), parts in by_document.items():
        wanted = [[*x, 2] for i, x in documents if i == doc_id and len(x) + 1 == tokens]
        wanted = wanted or [[2]]
        parts.sort()
        if len(wanted) == 1:
            assert [i for _, ids in parts for i in ids] == wanted[0]
        else:  # repeated rows
            assert sum(len(ids) for _, ids in parts) == sum(map(len, wanted))
    total = sum(len(x) + 1 for _, x in documents) + 1
    assert sum(r["length"] for r in rows) == total
    # At most one window a task is cut into powers of two; nothing is padded.
    lengths = [sum(length for _, length in parts) for parts in by_sequence.values()]
    assert all(n == window or n & (n - 1) == 0 for n in lengths)
    assert sum(n < window for n in lengths) <= 3 * 6
    assert packing.pack(frame.limit(0)).count() == 0


@pytest.mark.parametrize("max_open", [3, 4096])
def test_sum_of_squares_rule(max_open):
    """The level array makes the choices that the definition gives."""
    random_sizes = random.Random(4)
    window = 12
    packer = packing.Packer(window, max_open)
    counts = [0] * (window + 1)
    for n in range(500):
        size = random_sizes.randint(1, window - 1)
        piece = memoryview(bytes(4 * size))
        options = []
        for level in range(window - size + 1):
            if level and not counts[level]:
                continue
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] += 1
            options.append((sum(c * c for c in after), -level, after))
        expected = min(options)[2]
        full = list(packer.place(n, 0, piece))
        assert all(w.level == window for w in full)
        counts = [len(level) for level in packer.open]
        if max_open > 1000:
            assert counts == expected
        assert packer.count == sum(counts) <= max_open
    rest = list(packer.fill_up())
    assert sum(w.level < window for w in rest) <= 1


def test_query(spark, sf_dir):
    from tallyglass.llm.queries import QUERIES

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    ids = {
        d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for d, t in texts.items()
    }
    rows = QUERIES["op4_packing"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    covered = dict.fromkeys(texts, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["start"] == covered[r["doc_id"]]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["ids_crc32"] == zlib.crc32(piece.tobytes())
        covered[r["doc_id"]] += r["length"]
    assert covered == {d: len(x) for d, x in ids.items()}
