import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tallyglass.llm import best_fit
from tokenizers import Tokenizer


def one_by_one(lengths, window):
    """Room left in the windows when documents are placed singly, the longest first."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(window - length)
    return Counter(rooms)


def windows_of(steps, counts, window):
    """Fill of each window, checking that every window is filled without gaps."""
    used = {}
    for length, n in counts.items():
        numbers, offsets = best_fit.places(steps, np.full(n, length), np.arange(n))
        for w, o in zip(numbers.tolist(), offsets.tolist(), strict=True):
            used.setdefault(w, []).append((o, length))
    rooms = Counter()
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        rooms[window - end] += 1
    assert sorted(used) == list(range(len(used)))
    return rooms


@pytest.mark.parametrize("seed", range(30))
def test_runs_give_the_windows_of_single_documents(seed):
    r = random.Random(seed)
    window = r.choice([1, 7, 16, 50])
    some = [r.randint(1, window) for _ in range(r.randint(1, 6))]
    lengths = [r.choice(some) if seed % 2 else r.randint(1, window) for _ in range(r.randint(0, 300))]
    counts = Counter(lengths)
    steps = best_fit.plan(counts, window)
    if not lengths:
        assert steps == []
        return
    assert windows_of(steps, counts, window) == one_by_one(lengths, window)


def test_tightest_room():
    for most in (1, 2, 7, 8, 21):
        r = random.Random(most)
        rooms, held = best_fit.Capacities(most), Counter()
        for turn in range(400):
            room = r.randint(1, most)
            if held[room] and r.random() < 0.6:
                rooms.pop(room)
                held[room] -= 1
            else:
                rooms.push(room, turn, 1)
                held[room] += 1
            for length in range(1, most + 1):
                assert rooms.tightest(length) == min(
                    (x for x, n in held.items() if n and x >= length), default=None
                )


def test_plan_does_not_grow_with_the_table():
    r = random.Random(3)
    counts = {n: r.randint(1, 50) for n in range(1, 2049)}
    few = best_fit.plan(counts)
    many = best_fit.plan({n: c * 10**9 for n, c in counts.items()})
    assert len(many) < 40_000 and len(few) < 40_000


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_pieces(spark):
    window = 16
    r = random.Random(5)
    docs = [(i, [r.randint(1, 9) for _ in range(r.choice([0, 3, 7, 15, 16, 47, 200]))]) for i in range(300)]
    rows = [(i, packed(x), "p", "l") for i, x in docs]
    # A null value, a null id, repeated rows and a third of all rows alike.
    rows += [(900, None, "p", "l"), (None, packed([1, 2]), "p", "l"), (7, packed([4] * 9), "p", "l")]
    rows += [(901, packed([5, 5, 5]), "p", "l")] * 150
    frame = spark.createDataFrame(rows, "doc_id long, ids binary, piece string, Length string")
    found = best_fit.pack(frame.repartition(5), window=window).collect()
    whole = [(i, [*np.frombuffer(x or b"", "<u4").tolist(), 0]) for i, x, _, _ in rows]
    pieces = Counter(
        (i, n // window, n, tuple(x[n : n + window])) for i, x in whole for n in range(0, len(x), window)
    )
    got = Counter()
    by_sequence = {}
    for f in found:
        ids = np.frombuffer(bytes(f["ids"]), "<u4").tolist()
        assert f["length"] == len(ids) and f["ids_crc32"] == zlib.crc32(bytes(f["ids"]))
        got[f["doc_id"], f["piece"], f["start"], tuple(ids)] += 1
        by_sequence.setdefault(f["sequence_id"], []).append((f["offset"], f["length"]))
    assert got == pieces
    rooms = Counter()
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        rooms[window - end] += 1
    lengths = [len(ids) for (_, _, _, ids), n in pieces.items() for _ in range(n)]
    assert rooms == one_by_one(lengths, window)
    assert best_fit.pack(frame.limit(0), window=window).count() == 0
    with pytest.raises(ValueError):
        best_fit.pack(frame, window=0)


def test_shuffled_places_are_the_same(spark, monkeypatch):
    """Counts too many to broadcast are joined by a shuffle."""
    frame = spark.createDataFrame([(i, packed([1] * (i % 9))) for i in range(200)], "doc_id long, ids binary")
    monkeypatch.setattr(best_fit, "small_side", lambda df: df)
    rows = best_fit.pack(frame.repartition(7), window=10).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 200


def test_query(spark, sf_dir):
    from tallyglass.llm.queries import QUERIES

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    wanted, lengths = {}, []
    for d, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, start in enumerate(range(0, len(ids), 2048)):
            piece = ids[start : start + 2048]
            wanted[d, n] = (start, len(piece), zlib.crc32(piece.tobytes()))
            lengths.append(len(piece))
    rows = QUERIES["op13_best_fit"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == wanted
    assert len(rows) == len(wanted)
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert Counter(2048 - n for n in filled.values()) == one_by_one(lengths, 2048)
