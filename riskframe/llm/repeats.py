"""Passages of at least 50 words that a document with a smaller doc_id has too are removed.

1. Every document's words are cut into blocks of 25 at fixed places (0, 25, 50, ...): the index. Any 50
   words in a row hold a whole block of the document they lie in.
2. Every rolling window of 25 words is a probe. A probe whose hash is that of an indexed block and that
   occurs at least twice is a hit, in all documents that have it.
3. Hits are extended: the 50-word windows around them are compared by 128-bit fingerprints. A window is
   removed if a document with a smaller doc_id has it; windows that overlap make up the maximal
   exact repeats.

Probes travel packed, about six bytes each, in rows per bucket, where neighbours mostly share a bucket; a task that sees a hash twice
itself sends it once, and a fingerprint once per smallest document, so passages that very many
documents share stay small. Buckets are twice as many as shuffle tasks: set
spark.sql.shuffle.partitions so that such a share of the words fits in a task (about 100 bytes a word).

All windows are judged on the input. A null, empty or shorter text loses nothing. A row without
doc_id is neither smaller nor larger than others and is left as it is. Rows with equal doc_id do not
remove each other's words; identical rows have identical results. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.session import parallelism

from .common import Batches, keyed_texts, staged
from .hashing import mix, word_hashes

WINDOW, BLOCK = 50, 25
#: Words of the runs whose least hash chooses a probe's bucket.
INNER = 8
#: Words that one task looks at together.
GROUP_WORDS = 1_000_000
#: Odd bases of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, kept between groups."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))])
            self.up, self.down = steps(self.base), steps(self.inverse)
        return self.up[:n], self.down[:n]


_POWERS = tuple(Powers(b) for b in BASES)


def rolling(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each ``size`` values in a row: a polynomial over prefix sums."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS[which].get(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(which)) * up, dtype=np.uint64)])
    return mix((sums[size:] - sums[:-size]) * down[:n - size + 1])


def least_inner(words: np.ndarray, size: int, inner: int) -> np.ndarray:
    """For each ``size`` words the least hash of ``inner`` words in a row among them. Equal windows have
    equal values, and neighbouring windows mostly the same one: it deals a passage to few buckets."""
    return np.lib.stride_tricks.sliding_window_view(rolling(words, inner), size - inner + 1).min(axis=1)


def inside(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` words that lie in one of the documents laid end to end: start in the whole,
    document, start in the document."""
    counts = np.maximum(lengths - size + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), counts)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return (np.cumsum(lengths) - lengths)[doc] + pos, doc, pos


def pack(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """Entries in order of document and position: documents, entries of each, and position steps of a
    byte each with the larger ones apart."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    step = np.diff(pos, prepend=0)
    step[first] = pos[first]
    large = step >= 255
    return (doc[first], np.diff(np.append(first, len(doc))).astype("<u4").tobytes(),
            np.where(large, 255, step).astype(np.uint8).tobytes(), step[large].astype("<u4").tobytes())


def unpack(counts: bytes, steps: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Number of the document within the row, and position, of each entry."""
    n = np.frombuffer(counts, "<u4").astype(np.int64)
    step = np.frombuffer(steps, np.uint8).astype(np.int64)
    step[step == 255] = np.frombuffer(large, "<u4")
    total = np.cumsum(step)
    before = np.cumsum(n) - n
    return np.repeat(np.arange(len(n)), n), total - np.repeat(total[before] - step[before], n)


FIELDS = [("bucket", pa.int32()), ("ids", pa.binary()), ("tags", pa.binary()), ("counts", pa.binary()), ("steps", pa.binary()),
          ("large", pa.binary()), ("hashes", pa.binary()), ("marks", pa.binary())]
PACKED = "bucket int, ids binary, tags binary, counts binary, steps binary, large binary, hashes binary, marks binary"


def grouped_words(batches: Batches, columns: list[str]):
    """Groups of documents: the listed columns as lists, words' hashes end to end, lengths."""
    held: list[tuple] = []
    n = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), batch.column("text").to_pylist()):
            words = row[-1].encode().split()
            held.append((*row[:-1], word_hashes(words)))
            n += len(words)
            if n >= GROUP_WORDS:
                yield list(zip(*held))
                held, n = [], 0
    if held:
        yield list(zip(*held))


def rows_of(buckets: np.ndarray, ids: np.ndarray, tags: np.ndarray, doc, pos, hashes, marks) -> pa.RecordBatch:
    """One packed row per bucket; entries come in order of document and position."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=-1))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        part = order[a:b]
        docs, *rest = pack(doc[part], pos[part])
        out.append((int(buckets[part[0]]), ids[docs].tobytes(), tags[docs].tobytes() if len(tags) else b"", *rest,
                    hashes[part].tobytes() if len(hashes) else b"", np.packbits(marks[part]).tobytes() if len(hashes) else b""))
    columns = list(zip(*out)) if out else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], names=[f[0] for f in FIELDS])


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together (stable), and the number of the run of each in that order."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.cumsum(new)


def probes(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed probes of all documents. Rows without hashes hold hits found within one group."""
    def run(batches: Batches) -> Batches:
        spread = 0
        for ids, parts in grouped_words(batches, ["doc_id"]):
            ids, lengths = np.array(ids, dtype=np.int64), np.array([len(p) for p in parts])
            at, doc, pos = inside(lengths, BLOCK)
            if not len(at):
                continue
            words = np.concatenate(parts)
            h = rolling(words, BLOCK)[at]
            bucket = (least_inner(words, BLOCK, INNER)[at] % np.uint64(buckets)).astype(np.int32)
            order, run_no = runs(h)
            twice = np.bincount(run_no)[run_no] > 1
            first = np.concatenate([[True], run_no[1:] != run_no[:-1]])
            many, send = np.zeros(len(h), bool), np.zeros(len(h), bool)
            many[order], send[order] = twice, first
            # of windows seen twice here one is sent on, marked; all of them are hits already
            yield rows_of(bucket[send], ids, ids[:0], doc[send], pos[send],
                          h[send].astype("<u4"), many[send])
            if many.any():
                spread += 1
                yield rows_of(np.full(int(many.sum()), (spread + int(ids[0])) % buckets, np.int32), ids, ids[:0], doc[many], pos[many],
                              h[:0].astype("<u4"), many[:0])
    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, PACKED)


def _entries(table: pa.Table, wide: int):
    """All entries of the rows: ids, tags, positions, hashes [entry, wide], marks; rows without hashes
    come apart as (ids, tags, positions)."""
    full, bare = [], []
    for row in table.select([f[0] for f in FIELDS[1:]]).to_pylist():
        doc, pos = unpack(row["counts"], row["steps"], row["large"])
        ids = np.frombuffer(row["ids"], np.int64)[doc]
        tags = np.frombuffer(row["tags"], np.int64)[doc] if row["tags"] else np.zeros(len(ids), np.int64)
        if row["hashes"]:
            kind = "<u4" if wide == 1 else "<u8"
            full.append((ids, tags, pos, np.frombuffer(row["hashes"], kind).reshape(-1, wide), np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=len(ids)).view(bool)))
        else:
            bare.append((ids, tags, pos))
    return [np.concatenate(c) for c in zip(*full)], [np.concatenate(c) for c in zip(*bare)]


def _found(parts: list[tuple]) -> pa.Table:
    """Rows (doc_id, tag, at): positions of each document, packed."""
    parts = [p for p in parts if p and len(p[0])]
    if not parts:
        return pa.table({"doc_id": pa.array([], pa.int64()), "tag": pa.array([], pa.int64()), "at": pa.array([], pa.binary())})
    ids, tags, pos = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((pos, tags, ids))
    ids, tags, pos = ids[order], tags[order], pos[order].astype("<u4")
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]))
    ends = np.append(first[1:], len(ids))
    return pa.table({"doc_id": ids[first], "tag": tags[first],
                     "at": pa.array([pos[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())], pa.binary())})


def hits_in_bucket(table: pa.Table) -> pa.Table:
    full, bare = _entries(table, 1)
    hit: tuple = ()
    if full:
        ids, tags, pos, h, marks = full
        order, run_no = runs(h[:, 0])
        seen = np.bincount(run_no, weights=1 + marks[order])
        indexed = np.bincount(run_no, weights=pos[order] % BLOCK == 0) > 0
        keep = order[((seen > 1) & (indexed | (np.bincount(run_no, weights=marks[order]) > 0)))[run_no]]
        hit = (ids[keep], tags[keep], pos[keep])
    return _found([hit, tuple(bare)])


def covered_in_bucket(table: pa.Table) -> pa.Table:
    full, bare = _entries(table, 2)
    gone: tuple = ()
    if full:
        ids, tags, pos, h, _ = full
        order, run_no = runs(h[:, 0], h[:, 1])
        first = np.flatnonzero(np.concatenate([[True], run_no[1:] != run_no[:-1]]))
        keep = order[ids[order] > np.minimum.reduceat(ids[order], first)[run_no]]
        gone = (ids[keep], tags[keep], pos[keep])
    return _found([gone, tuple(bare)])


def windows_around(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed fingerprints of the 50-word windows that hold a hit: docs has doc_id, tag, text, hits."""
    def run(batches: Batches) -> Batches:
        spread = 0
        for ids, tags, hits, parts in grouped_words(batches, ["doc_id", "tag", "hits"]):
            ids, tags, lengths = np.array(ids, dtype=np.int64), np.array(tags, dtype=np.int64), np.array([len(p) for p in parts])
            at, doc, pos = inside(lengths, WINDOW)
            if not len(at):
                continue
            # a window from s on holds the hit at p if s <= p <= s + WINDOW - BLOCK
            begin = np.cumsum(lengths) - lengths
            marked = np.zeros(int(lengths.sum()) + 1, np.int64)
            for d, packed in enumerate(hits):
                p = np.concatenate([np.frombuffer(x, "<u4") for x in packed]).astype(np.int64)
                marked[begin[d] + p[p < lengths[d]]] = 1
            before = np.concatenate([[0], np.cumsum(marked)])
            near = before[at + WINDOW - BLOCK + 1] > before[at]
            at, doc, pos = at[near], doc[near], pos[near]
            if not len(at):
                continue
            words = np.concatenate(parts)
            h = np.stack([rolling(words, WINDOW, k)[at] for k in (0, 1)], axis=1)
            bucket = (least_inner(words, WINDOW, BLOCK)[at] % np.uint64(buckets)).astype(np.int32)
            order, run_no = runs(h[:, 0], h[:, 1])
            first = np.flatnonzero(np.concatenate([[True], run_no[1:] != run_no[:-1]]))
            gone = np.zeros(len(at), bool)
            gone[order] = ids[doc][order] > np.minimum.reduceat(ids[doc][order], first)[run_no]
            stay = ~gone  # may still be in a smaller document elsewhere
            yield rows_of(bucket[stay], ids, tags, doc[stay], pos[stay], h[stay].astype("<u8"), stay[stay])
            if gone.any():
                spread += 1
                yield rows_of(np.full(int(gone.sum()), (spread + int(ids[0])) % buckets, np.int32), ids, tags, doc[gone], pos[gone],
                              h[:0].astype("<u8"), gone[:0])
    return docs.mapInArrow(run, PACKED)


def cut_text(text: str, packed: list[bytes] | None) -> tuple[int, int, str]:
    """Words, words removed, and the words that stay joined by blanks."""
    words = text.encode().split()
    if not packed:
        return len(words), 0, b" ".join(words).decode()
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.concatenate([np.frombuffer(x, "<u4") for x in packed]).astype(np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    stays = np.cumsum(edges[:-1]) == 0
    return len(words), int((~stays).sum()), b" ".join([words[i] for i in np.flatnonzero(stays).tolist()]).decode()


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, text (the words that stay)."""
    buckets = 2 * parallelism(docs.sparkSession)
    texts = keyed_texts(docs, id_col, text_col)
    found = "doc_id long, tag long, at binary"
    hits = staged(probes(texts, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(hits_in_bucket, found))
    per_doc = hits.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_list("at").alias("hits"))
    joined = staged(texts.join(per_doc, F.col("doc_id") == F.col("hit_id"), "left").select(
        "doc_id", "text", "hits", F.xxhash64("text").alias("tag")))
    some = joined.filter("hits is not null")
    gone = staged(windows_around(some, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(covered_in_bucket, found))
    starts = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag")).agg(F.collect_list("at").alias("starts"))
    cut = some.select("doc_id", "text", "tag").join(
        starts, (F.col("doc_id") == F.col("gone_id")) & (F.col("tag") == F.col("gone_tag")), "left").select("doc_id", "text", "starts")
    whole = joined.filter("hits is null").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("starts"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = [cut_text(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist())]
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))],
                names=["doc_id", "n_words", "n_removed", "text"])

    schema = "doc_id long, n_words long, n_removed long, text string"
    return whole.mapInArrow(run, schema).unionByName(cut.mapInArrow(run, schema))
