"""Best-fit decreasing packing of documents into windows of a fixed number of tokens.

A document longer than a window is first cut into full windows; what is left of it is one more piece.
Pieces are placed from the longest down, each into the open window with the least room that still
takes it, found with a segment tree indexed by remaining room.

Pieces of one length are alike, so the placement needs only how many pieces each length has: at most
``window`` numbers, whatever the size of the corpus. The driver packs those counts in runs (this many
windows with this much room take that many pieces each); each piece then finds its window from its
length and its rank among the pieces of that length. Ranks are counted in salted groups, so a length
that a third of all pieces share is not one task's work.

Null or empty text: the end id alone. Ties between windows of equal room go to the run opened first;
repeated rows are packed like others, so every id lies in exactly one piece. Empty table: no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.session import parallelism

from .common import Batches, in_slices, keyed_texts, staged
from .tokens import encode_all, encoder

WINDOW = 1024
#: Salts of the rank counting: one per shuffle task, at most this many.
MAX_SALTS = 1024


class RoomTree:
    """Segment tree over room 0..window that tells the least room of at least n with an open window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = bytearray(2 * self.leaves)

    def mark(self, room: int, is_open: bool) -> None:
        at = room + self.leaves
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, needed: int) -> int | None:
        at = needed + self.leaves
        if self.open[at]:
            return needed
        while at > 1:  # up until a right sibling has something open, then down to its left end
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def pack_counts(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Runs (length, first rank, pieces, per window, first window, offset): the pieces of ranks
    first..first+pieces-1 go, ``per window`` at a time, to consecutive windows from ``offset`` on."""
    tree, runs, windows = RoomTree(window), [], 0
    free: dict[int, deque[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not free.setdefault(room, deque()):
                tree.mark(room, True)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # open as many windows as these pieces need
                room, first = window, windows
                n = -(-left // (window // length))
                windows += n
            else:
                first, n = free[room].popleft()
                if not free[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(n, left // each)
            for of, take in ((full, each), (1 if full < n and left % each and full == left // each else 0, left - full * each)):
                if of:
                    runs.append((length, rank, of * take, take, first, window - room))
                    put(room - take * length, first, of)
                    rank, left, first, n = rank + of * take, left - of * take, first + of, n - of
            put(room, first, n)
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


def cut_pieces(ids: bytes, window: int):
    """(start, length, ids) of the pieces of one document."""
    for at in range(0, len(ids), 4 * window):
        part = ids[at:at + 4 * window]
        yield at // 4, len(part) // 4, part


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, salt and, if asked for, ids."""
    salts = min(MAX_SALTS, max(16, parallelism(docs.sparkSession)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"] + ["ids"] * with_ids
    end = struct.pack("<I", end_id)

    def run(batches: Batches) -> Batches:
        coder, row = encoder(vocabulary, "leading"), 0
        for batch in in_slices(batches):
            out: list[tuple] = []
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode_all(coder, batch.column("text").to_pylist())):
                ids += end
                for start, length, part in cut_pieces(ids, window):
                    out.append((key, start, length, zlib.crc32(part), len(ids) // 4, row % salts, part)[:len(names)])
                    row += 1
            columns = list(zip(*out)) if out else [[]] * len(names)
            types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt int" + ", ids binary" * with_ids
    return keyed_texts(docs, id_col, text_col).mapInArrow(run, schema)


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces. ``cut`` is read twice: pass a written table."""
    counts = cut.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("length").alias("of_length"), F.col("salt").alias("of_salt"),
                           F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_rank"))
    # at most one row per length up to the window
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pack_counts(lengths, window)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = plan[:, 0] << 44 | plan[:, 1]
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(
        starts, (F.col("length") == F.col("of_length")) & (F.col("salt") == F.col("of_salt")))
    kept = [c for c in cut.columns if c != "salt"]

    def find(batches: Batches) -> Batches:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = plan[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            within = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(run[:, 4] + within // run[:, 3]),
                 pa.array(run[:, 5] + within % run[:, 3] * length)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes if n != "salt") + ", sequence_id long, offset long"
    return ranked.select(*kept, (F.col("rank") + F.col("first_rank")).alias("rank")).mapInArrow(find, schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = WINDOW, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place. The pieces are written once, since counting and placing both read them."""
    return place(staged(pieces(docs, vocabulary, end_id, window, with_ids, id_col, text_col)), window)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The training windows of pieces that carry ids: sequence_id, n_tokens, ids (padded, binary)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_ids, p: F.concat(all_ids, p.ids))
    rows = packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
    pad = F.lit(struct.pack("<I", pad_id) * window)
    return rows.select("sequence_id", "n_tokens", F.substring(F.concat("ids", pad), 1, 4 * window).alias("ids"))
