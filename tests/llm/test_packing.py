import struct
import zlib
from bisect import bisect_left, insort

import pytest
from hypothesis import given, settings, strategies as st

from riskframe.llm import packing
from llm_helpers import docs, odd_texts, real_texts, vocabulary


def plain_best_fit(lengths, window):
    """Free room of each window after best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else window
        insort(rooms, room - n)
    return rooms


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_runs_equal_placing_one_by_one(lengths):
    window = 40
    counts = {n: lengths.count(n) for n in set(lengths)}
    used, ranks = {}, {}
    for length, rank, n, each, first, offset in packing.pack_counts(counts, window).tolist():
        for i in range(n):
            ranks.setdefault(length, []).append(rank + i)
            used.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert sorted(used) == list(range(len(used)))
    for taken in used.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(window - sum(n for _, n in t) for t in used.values()) == sorted(plain_best_fit(lengths, window))


def test_tree_finds_the_tightest_room():
    tree = packing.RoomTree(16)
    for room in (3, 9, 16):
        tree.mark(room, True)
    assert [tree.tightest(n) for n in (0, 3, 4, 9, 10, 16)] == [3, 3, 9, 9, 16, 16]
    tree.mark(16, False)
    assert tree.tightest(10) is None


def test_every_id_lies_in_one_piece(spark, sf):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    texts = odd_texts() + real_texts(spark, sf) + ["copy of a hot text"] * 300
    rows = packing.pack(docs(spark, texts), path, with_ids=True, window=64).collect()
    plain = Tokenizer.from_file(path)
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, text in enumerate(texts):
        want = plain.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in parts) == struct.pack(f"<{len(want)}I", *want)
        assert [p["start"] for p in parts] == list(range(0, len(want), 64))
        assert all(p["doc_tokens"] == len(want) and p["ids_crc32"] == zlib.crc32(p["ids"]) for p in parts)
    for taken in by_window.values():
        at = 0
        for r in sorted(taken, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert len(by_window) == len(plain_best_fit([r["length"] for r in rows], 64))


def test_sequences_hold_the_ids(spark):
    packed = packing.pack(docs(spark, ["a b c", "d e", None, "f " * 50]), vocabulary("byte_bpe_50k.json"), with_ids=True, window=32)
    for row in packing.sequences(packed, 32).collect():
        assert len(row["ids"]) == 128 and row["ids"][4 * row["n_tokens"]:].strip(b"\0") == b""


def test_empty_table_and_clashing_columns(spark):
    empty = docs(spark, ["x"]).filter("false")
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    clash = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, length int, salt int, start int")
    assert [r["length"] for r in packing.pack(clash, vocabulary("byte_bpe_50k.json")).collect()] == [3]


@pytest.mark.parametrize("rows", [[(None, "a"), (None, "a"), (3, None)]])
def test_null_and_repeated_keys(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, vocabulary("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in got) == [(False, 1), (True, 2), (True, 2)]
