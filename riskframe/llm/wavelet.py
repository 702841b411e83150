"""Token ids in shards, each a wavelet matrix.

A shard holds the ids of consecutive documents as one bit plane per id bit, from the highest. Behind
a plane the ids are split, zeros first and in order, so the next plane refers to the new order. With
counts of ones per block of each plane, a shard answers without being unpacked:

    access(i)          the id at position i
    rank(id, i)        how often the id occurs before position i
    select(id, k)      the position of its k-th occurrence

A shard is one row of a Parquet file, compressed: where it starts, the documents in it, and the
planes. A task writes its shards as it goes, so its memory does not depend on its share of the rows.

Order is by doc_id (nulls first), then by a hash of the text; rows equal in both are alike. Null or
empty text: the end id alone. An empty table gives no shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.session import parallelism, shared_dir

from .common import Batches, keyed_texts
from .tokens import encode_all, encoder

#: Ids after which a shard is closed; a single longer document still is in one shard.
SHARD_IDS = 1 << 20
#: Bits between two stored counts.
BLOCK = 512
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], counts: list[np.ndarray]):
        """planes: packed bits, highest first; counts: ones before each block."""
        self.n, self.planes, self.counts = n, planes, counts
        self.zeros = [n - self.ones_before(level, n) for level in range(len(planes))]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n, rest = len(ids), ids
        n_bits = max(1, int(ids.max()).bit_length()) if n else 1
        planes, counts = [], []
        if n_bits <= 16:  # half the memory to move
            rest = rest.astype(np.uint16)
        for bit in reversed(range(n_bits)):
            ones = (rest >> bit & 1).astype(bool)
            packed = np.packbits(ones)
            per_byte = _ONES[np.pad(packed, (0, -len(packed) % (BLOCK // 8)))]
            blocks = per_byte.reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            planes.append(packed)
            counts.append(np.concatenate([[0], np.cumsum(blocks)]).astype("<u4"))
            rest = np.concatenate([rest.compress(~ones), rest.compress(ones)])  # a third of the time of rest[ones]
        return cls(n, planes, counts)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def ones_before(self, level: int, i: int) -> int:
        block = i // BLOCK
        total = int(self.counts[level][block])
        plane = self.planes[level]
        total += int(_ONES[plane[block * BLOCK // 8:i >> 3]].sum())
        return total + (int(_ONES[plane[i >> 3] >> (8 - (i & 7))]) if i & 7 else 0)

    def _down(self, level: int, i: int, one: int) -> int:
        ones = self.ones_before(level, i)
        return self.zeros[level] + ones if one else i - ones

    def access(self, i: int) -> int:
        found = 0
        for level in range(len(self.planes)):
            one = self.bit(level, i)
            found = found << 1 | one
            i = self._down(level, i, one)
        return found

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences before position i lie in the last order."""
        if token >> len(self.planes):
            return 0, 0
        start, end = 0, i
        for level in range(len(self.planes)):
            one = token >> (len(self.planes) - 1 - level) & 1
            start, end = self._down(level, start, one), self._down(level, end, one)
        return start, end

    def rank(self, token: int, i: int | None = None) -> int:
        start, end = self._range(token, self.n if i is None else i)
        return end - start

    def _nth(self, level: int, k: int, one: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane: a search among the stored counts,
        then within one block."""
        counts = self.counts[level].astype(np.int64)
        if not one:
            counts = np.arange(len(counts), dtype=np.int64) * BLOCK - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(counts[block])])

    def select(self, token: int, k: int) -> int:
        start, end = self._range(token, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for level in reversed(range(len(self.planes))):
            one = token >> (len(self.planes) - 1 - level) & 1
            at = self._nth(level, at - self.zeros[level] if one else at, one)
        return at

    def all_ids(self) -> np.ndarray:
        """Every id in order: undo the splits from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        rest = np.zeros(self.n, dtype=kind)
        for level in reversed(range(len(self.planes))):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            before = np.empty_like(rest)
            before[np.flatnonzero(~ones)] = rest[:self.zeros[level]]
            before[np.flatnonzero(ones)] = rest[self.zeros[level]:] | kind(1 << (len(self.planes) - 1 - level))
            rest = before
        return rest


SCHEMA = ("part int, first long, n_ids long, doc_ids array<long>, doc_ends array<long>, "
          "planes array<binary>, counts array<binary>")
_ARROW = pa.schema([
    ("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_ends", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode, put in order and write the shards. ``part`` numbers the tasks in order of doc_id and
    ``first`` counts the ids before the shard within its task."""
    end = struct.pack("<I", end_id)

    def run(batches: Batches) -> Batches:
        coder, part, first = encoder(vocabulary, "dropped"), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), dtype="<u4"))
            row = {
                "part": part, "first": first, "n_ids": matrix.n, "doc_ids": keys,
                "doc_ends": np.cumsum([len(p) // 4 for p in parts]).tolist(),
                "planes": [p.tobytes() for p in matrix.planes], "counts": [c.tobytes() for c in matrix.counts],
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode_all(coder, batch.column("text").to_pylist())):
                keys.append(key)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= SHARD_IDS:
                    yield shard()
                    first, held, keys, parts = first + held, 0, [], []
        if keys:
            yield shard()

    n = parallelism(docs.sparkSession)
    texts = keyed_texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    ordered = texts.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"


def shard_matrix(n: int, planes: list[bytes], counts: list[bytes]) -> WaveletMatrix:
    return WaveletMatrix(n, [np.frombuffer(p, np.uint8) for p in planes], [np.frombuffer(c, "<u4") for c in counts])


def starts(shards: DataFrame) -> dict[int, int]:
    """Ids before each writing task: one number per task that wrote."""
    totals = sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([t["n"] for t in totals])]) if totals else []
    return {t["part"]: int(b) for t, b in zip(totals, before)}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    before = starts(shards)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                raw = shard_matrix(row["n_ids"], row["planes"], row["counts"]).all_ids().astype("<u4").tobytes()
                ends = np.array(row["doc_ends"], dtype=np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(begins + before[row["part"]] + row["first"]),
                     pa.array(ends - begins), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Positions of one id, looked up in the planes: part, position within the part's ids."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                matrix = shard_matrix(row["n_ids"], row["planes"], row["counts"])
                at = [row["first"] + matrix.select(token, k) for k in range(matrix.rank(token))]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(at), pa.int32()), pa.array(at, pa.int64())],
                                                 names=["part", "position"])
    return spark.read.schema(SCHEMA).parquet(path).select("part", "first", "n_ids", "planes", "counts").mapInArrow(
        run, "part int, position long")
