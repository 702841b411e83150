"""Prefix trie of conversations: every distinct beginning of d turns is a node.

Method: conversations are sorted by the sequence of their turns. Neighbours' longest common prefixes (LCP)
are edges; taken in descending depth, union-find merges the two components of an edge, and each merge
creates a branching node. That runs per partition of the sorted order. Nodes on the path of a
partition's first or last conversation may go on in the next partition: these paths, the contracted
forest, leave a partition as partial sums and are merged across boundaries by the digest of their prefix.

How it is spread:
    * a turn travels as 16 bytes of its digest and the length of its text, never as text;
    * equal conversations become one row with a count before sorting, so copies make no hot range;
    * a conversation of more than ``BLOCK`` turns is cut into blocks. A later block is a conversation of its
      own that starts with the digest of all before it, and the deepest blocks are merged first: what lies
      below them is handed to the ends of the blocks before, so no row grows with a conversation;
    * ranges are cut by the first ``RANGE_TURNS`` turns, and there are as many as the digests' bytes ask for;
    * a partition keeps numbers per conversation and per node, and digests of two conversations only.

Turns are told apart by 128 bits of SHA-256 over role and text.

Defined cases: a null role or text counts as empty; turns are ordered by ``turn`` (null first), ties by digest;
repeated rows are further turns; rows without conv_id belong to no conversation. A conversation without
turns is a member of the root. An empty table gives no node, not even a root. Other columns stay outside.
Texts of any length cost one digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.operators.joins import attach
from riskframe.session import parallelism, settle

from .common import Batches, keep_only, staged

#: Turns of a conversation that are one row; bytes of digests a sorting task should get.
BLOCK, RANGE_TURNS, RANGE_BYTES = 4096, 16, 16 << 20
WIDTH = 16
#: Conversations of a hundred share the beginning of the first; at most HEAD - 1 turns of it.
FAMILY, HEAD = 100, 6

NODES = ("final boolean, part int, first boolean, last boolean, depth long, fp binary, parent_fp binary, conv_id long, "
         "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, length long, end_fp binary")


# --- turns -----------------------------------------------------------------------------

def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, length of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.unhex(F.substring(F.sha2(told.cast("binary"), 256), 1, 2 * WIDTH)).alias("digest"), F.length(text).cast("long").alias("length"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "length")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, digest, length after the beginning of each conversation has been replaced by the first
    h turns of its family's first one. Every conversation also has a row with pos 0 and no digest."""
    turns = ordered_turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    one = F.struct("pos", "digest", "length")
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos") < HEAD, one))).alias("own"))
    base = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base_id"), F.col("own").alias("from"))
    heads = convs.join(base, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base_id"), "left").select(
        "conv_id", F.slice(F.coalesce("from", F.array().cast("array<struct<pos:bigint,digest:binary,length:bigint>>")), F.lit(1), h.cast("int")).alias("head"))
    # the head's turns keep their positions; the own ones follow it
    own = turns.filter(F.col("pos") > h).join(heads.select("conv_id", F.size("head").alias("taken")), "conv_id").select(
        "conv_id", (F.col("pos") - h + F.col("taken")).alias("pos"), "digest", "length")
    first = heads.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    marks = heads.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("length"))
    return own.unionByName(first).unionByName(marks)


# --- blocks ------------------------------------------------------------------------------

def _joined(parts: Column) -> Column:
    """Binary values one behind the other."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, k, is_last, start (digest of all blocks before; null for k = 0), key, lengths, fp of every block."""
    at = F.floor((F.greatest(F.col("pos"), F.lit(1)) - 1) / block).cast("int").alias("k")
    one = F.when(F.col("digest").isNotNull(), F.struct("pos", "digest", "length"))
    rows = turns.groupBy("conv_id", at).agg(F.array_sort(F.collect_list(one)).alias("t")).select(
        "conv_id", "k", _joined(F.col("t.digest")).alias("key"), F.col("t.length").alias("lengths"))
    by_conv = Window.partitionBy("conv_id").orderBy("k")
    # a sum of digests that depend on their place stands for a sequence of blocks
    sums = [F.sum(F.xxhash64(F.lit(i), F.col("k"), F.col("key")).cast("decimal(38,0)")).over(by_conv) for i in range(2)]
    all_so_far = F.unhex(F.substring(F.sha2(F.concat_ws(",", "k", *[s.cast("string") for s in sums]).cast("binary"), 256), 1, 2 * WIDTH))
    told = rows.withColumn("fp", all_so_far)
    return told.select(
        "conv_id", "k", F.lead("k").over(by_conv).isNull().alias("is_last"), F.lag("fp").over(by_conv).alias("start"), "key", "lengths", "fp")


def _distinct(rows: DataFrame, k: int, below: DataFrame | None) -> DataFrame:
    """One row per distinct block sequence up to k, with its members and what lies below its end."""
    mine = rows.filter(F.col("k") == k)
    prefix = F.concat("start", "key") if k else F.col("key")
    lengths = F.concat(F.array(F.lit(0).cast("long")), "lengths") if k else F.col("lengths")
    found = mine.groupBy("fp").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("is_last").alias("ends"),
        F.first(prefix).alias("key"), F.first(lengths).alias("lengths"))
    if below is None:
        extra = found.withColumns({c: F.lit(0).cast("long") for c in ("more_children", "more_leaves", "more_saved")})
    else:
        extra = found.join(below, "fp", "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
    return extra.select(
        "key", "lengths", "n", "least", F.when(F.col("ends"), F.col("fp")).alias("end_fp"), "more_children", "more_leaves", "more_saved")


# --- one partition ------------------------------------------------------------------------

def _lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their beginning."""
    at, most = 0, min(len(a), len(b))
    step = 4 * WIDTH
    while at + step <= most and a[at:at + step] == b[at:at + step]:
        at += step
    while at < most and a[at:at + WIDTH] == b[at:at + WIDTH]:
        at += WIDTH
    return at // WIDTH


class Forest:
    """The trie of one partition's sorted conversations, node by node.

    Conversation i brings the nodes deeper than ``lcp[i]``; node (i, d) has the number ``at[i] + d - lcp[i] - 1``
    and the root the last number. Values of nodes on the paths of the first and last conversation are partial.
    """

    def __init__(self):
        self.lcp: list[int] = []
        self.size: list[int] = []
        self.at: list[int] = []
        self.rows: list[tuple] = []  # n, least, end_fp, more_children, more_leaves, more_saved
        self._lengths: list[np.ndarray] = []
        self.total = 0
        self.first_key = self.last_key = b""

    def add(self, key: bytes, lengths: list[int], row: tuple) -> None:
        shared = _lcp(self.last_key, key) if self.rows else 0
        if not self.rows:
            self.first_key = key
        self.last_key = key
        self.lcp.append(shared)
        self.size.append(len(key) // WIDTH)
        self.at.append(self.total)
        self.rows.append(row)
        self._lengths.append(np.asarray(lengths[shared:], dtype=np.int64))
        self.total += self.size[-1] - shared

    def _parents(self) -> tuple[np.ndarray, list[int], list[int]]:
        """Each node's parent, and the nodes on the path of the last conversation, by depth from 1. The
        stack holds the path of the conversation at hand."""
        parent = np.arange(-1, self.total, dtype=np.int64)  # within a conversation the node before
        stack: list[tuple[int, int]] = []  # (deepest depth it owns on the path, number minus depth)
        for i, (shared, size, at) in enumerate(zip(self.lcp, self.size, self.at)):
            while stack and (stack[-2][0] if len(stack) > 1 else 0) >= shared and stack[-1][0] > shared:
                stack.pop()
            if stack and stack[-1][0] > shared:
                stack[-1] = (shared, stack[-1][1])
            if size > shared:
                parent[at] = stack[-1][1] + shared if shared else self.total
                stack.append((size, at - shared - 1))
        parent[self.total] = -1
        last, done = [], 0
        for deepest, shift in stack:
            last.extend(shift + d for d in range(done + 1, deepest + 1))
            done = deepest
        return parent, last, list(range(self.size[0] if self.size else 0))

    def solve(self) -> dict[str, np.ndarray]:
        m, root = len(self.rows), self.total
        lengths = np.concatenate([*self._lengths, [0]]).astype(np.int64)
        n, least, children, leaves, saved = (np.zeros(root + 1, dtype=np.int64) for _ in range(5))
        # components by their leftmost conversation: depth of the top, and sums over what is below it
        top = list(self.size)
        c_n, c_least = [r[0] for r in self.rows], [r[1] for r in self.rows]
        c_children, c_leaves, c_saved = ([r[i] for r in self.rows] for i in (3, 4, 5))
        left = list(range(m))  # union-find; a component's root is its leftmost conversation

        def find(i: int) -> int:
            while left[i] != i:
                left[i] = left[left[i]]
                i = left[i]
            return i

        def close(c: int, depth: int) -> tuple[int, int]:
            """Write the nodes of a component deeper than ``depth``; leaves and saved tokens at depth + 1."""
            hi = self.at[c] + top[c] - self.lcp[c]  # behind its top
            lo = hi - (top[c] - depth)
            leaf = c_leaves[c] if c_children[c] else 1
            n[lo:hi], least[lo:hi], children[lo:hi], leaves[lo:hi] = c_n[c], c_least[c], 1, leaf
            children[hi - 1] = c_children[c]
            if c_n[c] == 1 and not c_saved[c]:
                return leaf, 0
            saved[lo:hi] = np.cumsum(lengths[lo:hi][::-1] * (c_n[c] - 1))[::-1] + c_saved[c]
            return leaf, int(saved[lo])

        shared = np.asarray(self.lcp, dtype=np.int64)
        for i in (np.argsort(-shared[1:], kind="stable") + 1).tolist():
            depth, a, b = self.lcp[i], find(i - 1), i
            if top[a] > depth:  # the merge creates a branching node
                c_leaves[a], c_saved[a] = close(a, depth)
                c_children[a], top[a] = 1, depth
            if top[b] > depth:
                more = close(b, depth)
                c_children[a] += 1
            else:
                more = (c_leaves[b], c_saved[b])
                c_children[a] += c_children[b]
            c_leaves[a] += more[0]
            c_saved[a] += more[1]
            c_n[a] += c_n[b]
            c_least[a] = min(c_least[a], c_least[b])
            left[b] = a
        if m:
            if top[0] > 0:
                close(0, 0)
            n[root], least[root] = c_n[0], c_least[0]
        parent, last, first = self._parents()
        ends = np.full(root + 1, -1, dtype=np.int64)  # the conversation that ends in a node
        for i, (size, shared_, at) in enumerate(zip(self.size, self.lcp, self.at)):
            ends[at + size - shared_ - 1 if size else root] = i
        return {"n": n, "least": least, "children": children, "leaves": leaves, "saved": saved, "length": lengths,
                "parent": parent, "ends": ends, "first": np.asarray(first, dtype=np.int64), "last": np.asarray(last, dtype=np.int64)}


def _prefix_digests(key: bytes) -> list[bytes]:
    """Digest of each beginning of a key, by depth from 0."""
    h, out = hashlib.sha256(), [hashlib.sha256().digest()[:WIDTH]]
    for at in range(0, len(key), WIDTH):
        h.update(key[at:at + WIDTH])
        out.append(h.copy().digest()[:WIDTH])
    return out


def _grow(schema: pa.Schema):
    names = ["key", "lengths", "n", "least", "end_fp", "more_children", "more_leaves", "more_saved"]

    def run(batches: Batches) -> Batches:
        keep_only("trie")
        forest = Forest()
        for batch in batches:
            for key, lengths, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                forest.add(key, lengths, tuple(row))
        if not forest.rows:
            return
        got, root = forest.solve(), forest.total
        part = TaskContext.get().partitionId()
        depth = np.zeros(root + 1, dtype=np.int64)
        sizes, shared = np.asarray(forest.size), np.asarray(forest.lcp)
        depth[:root] = np.arange(root) - np.repeat(np.asarray(forest.at) - shared - 1, sizes - shared)
        on_first, on_last = np.zeros(root + 1, dtype=bool), np.zeros(root + 1, dtype=bool)
        on_first[got["first"]] = on_last[got["last"]] = True
        on_first[root] = on_last[root] = True
        edge = on_first | on_last
        fp: dict[int, bytes] = {}
        for nodes, key in ((got["first"], forest.first_key), (got["last"], forest.last_key)):
            fp.update(zip([root, *nodes.tolist()], _prefix_digests(key)))
        parent, rows, ends = got["parent"], forest.rows, got["ends"]
        hangs = ~edge[:root] & edge[parent[:root]] if root else np.zeros(0, dtype=bool)
        # what hangs below the nodes of the two paths, and the conversations that end there
        sums = {c: np.zeros(root + 1, dtype=np.int64) for c in ("children", "leaves", "saved")}
        for name, values in (("children", np.ones(root, dtype=np.int64)), ("leaves", got["leaves"][:root]), ("saved", got["saved"][:root])):
            np.add.at(sums[name], parent[:root][hangs], values[hangs])
        for node in np.flatnonzero(edge & (ends >= 0)).tolist():
            for name, more in zip(("children", "leaves", "saved"), rows[ends[node]][3:]):
                sums[name][node] += more
        values = {c: np.where(edge, sums[c], got[c]) for c in sums}
        for lo in range(0, root + 1, 50_000):
            at = np.arange(lo, min(lo + 50_000, root + 1))
            up = parent[at]
            known = ~edge[np.maximum(up, 0)] & (up >= 0) & ~edge[at]
            to_edge = (up >= 0) & edge[np.maximum(up, 0)]
            yield pa.RecordBatch.from_arrays([
                pa.array(~edge[at]), pa.array(np.full(len(at), part, dtype=np.int32)), pa.array(on_first[at]), pa.array(on_last[at]),
                pa.array(depth[at]), pa.array([fp.get(x) if e else None for x, e in zip(at.tolist(), edge[at].tolist())], pa.binary()),
                pa.array([fp.get(x) if e else None for x, e in zip(up.tolist(), to_edge.tolist())], pa.binary()),
                pa.array(got["least"][at]), pa.array(got["least"][np.maximum(up, 0)], mask=~known), pa.array(got["n"][at]),
                *[pa.array(values[c][at]) for c in ("children", "leaves", "saved")], pa.array(got["length"][at]),
                pa.array([rows[i][2] if i >= 0 else None for i in ends[at].tolist()], pa.binary()),
            ], schema=schema)
    return run


_SCHEMA = pa.schema([
    ("final", pa.bool_()), ("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("depth", pa.int64()), ("fp", pa.binary()),
    ("parent_fp", pa.binary()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("length", pa.int64()), ("end_fp", pa.binary())])


# --- across boundaries ------------------------------------------------------------------

def _merge_edges(grown: DataFrame) -> DataFrame:
    """The nodes on partitions' boundary paths, merged by the digest of their prefix and with the sums of
    their subtrees. There are at most two paths per partition.

    A node belongs to the first path that holds it. The nodes a path owns are its deepest ones, so a
    running sum from its end gives what it adds to each of its nodes, and paths add up to subtrees.
    """
    edge = grown.filter("NOT final")
    path = F.array_compact(F.array(F.when(F.col("first"), F.col("part") * 2), F.when(F.col("last"), F.col("part") * 2 + 1)))
    merged = edge.groupBy("fp").agg(
        F.max("depth").alias("depth"), F.max("parent_fp").alias("parent_fp"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("length").alias("length"), F.max("end_fp").alias("end_fp"), F.min(F.array_min(path)).alias("owner"))
    kids = merged.filter("parent_fp IS NOT NULL").groupBy(F.col("parent_fp").alias("fp")).agg(F.count("*").alias("edge_children"))
    full = staged(merged.join(kids, "fp", "left").withColumn("n_children", F.col("n_children") + F.coalesce("edge_children", F.lit(0))).drop("edge_children"))
    on = edge.select("fp", F.explode(path).alias("path")).distinct().join(full, "fp")
    own = F.col("owner") == F.col("path")
    below = Window.partitionBy("path").orderBy(F.col("depth").desc())
    adds = lambda c: F.sum(F.when(own, c).otherwise(0)).over(below)
    sums = on.select(
        "fp", adds(F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("all_leaves"),
        adds(F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("length")).alias("all_saved"),
    ).groupBy("fp").agg(F.sum("all_leaves").alias("all_leaves"), F.sum("all_saved").alias("all_saved"))
    up = full.select(F.col("fp").alias("parent_fp"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(sums, "fp").join(up, "parent_fp", "left").select(
        "fp", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", F.col("all_leaves").alias("n_leaves"),
        F.col("all_saved").alias("saved_tokens"), "end_fp")


def _level(rows: DataFrame) -> DataFrame:
    """All nodes of the trie of some distinct sequences."""
    spark = rows.sparkSession
    rows = staged(rows)
    size = rows.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    tasks = max(parallelism(spark), -(-size // RANGE_BYTES))
    begun = F.substring(F.col("key"), 1, RANGE_TURNS * WIDTH)
    dealt = rows.repartitionByRange(tasks, begun).sortWithinPartitions("key")
    grown = staged(dealt.mapInArrow(_grow(_SCHEMA), NODES))
    edges = staged(_merge_edges(grown))
    final = grown.filter("final")
    wanted = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_fp"]
    inner = final.filter("parent_fp IS NULL").select(*wanted)
    table, small = settle(edges.select(F.col("fp").alias("parent_fp"), F.col("conv_id").alias("up")))
    hanging = attach(final.filter("parent_fp IS NOT NULL").drop("parent_conv_id"), table, ["parent_fp"], small).withColumnRenamed("up", "parent_conv_id")
    return inner.unionByName(hanging.select(*wanted)).unionByName(edges.select(*wanted))


def _ends(batches: Batches) -> Batches:
    """Rows sorted by fp and conv_id -> the digest of the comma-joined ids of each fp, streamed."""
    fp, h = None, None
    out: list[tuple[bytes, str]] = []
    for batch in batches:
        for mine, conv_id in zip(batch.column("fp").to_pylist(), batch.column("conv_id").to_pylist()):
            if mine != fp:
                if h is not None:
                    out.append((fp, h.hexdigest()))
                fp, h = mine, hashlib.sha256(str(conv_id).encode())
            else:
                h.update(b",%d" % conv_id)
        if len(out) > 10_000:
            yield _digests(out)
            out = []
    if h is not None:
        out.append((fp, h.hexdigest()))
    yield _digests(out)


def _digests(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], ["end_fp", "ends_sha256"])


def nodes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, pos, digest, length (`rebuilt`, `ordered_turns`) -> the trie's nodes: conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = staged(blocks(turns, block))
    deepest = rows.agg(F.max("k")).first()[0] or 0
    found, below = None, None
    for k in range(deepest, -1, -1):
        level = _level(_distinct(rows, k, below))
        if k:
            # depth 0 stands for nothing, depth 1 for the end of the block before, which that block reports
            level = staged(level)
            below = _below(rows, k, level)
            level = _named(rows, k, level).withColumn("depth", F.col("depth") - 1 + k * block)
        found = level if found is None else found.unionByName(level)
    found = staged(found) if deepest else found
    ends = rows.filter("is_last").select("fp", "conv_id").repartition("fp").sortWithinPartitions("fp", "conv_id").mapInArrow(
        _ends, "end_fp binary, ends_sha256 string")
    ended = found.filter("end_fp IS NOT NULL").join(ends, "end_fp").drop("end_fp")
    passed = found.filter("end_fp IS NULL").drop("end_fp").withColumn("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return passed.unionByName(ended).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _named(rows: DataFrame, k: int, level: DataFrame) -> DataFrame:
    """The nodes below depth 1. Their topmost ones get the name of the node that ends the block before: members
    of it that end there too are not in this level."""
    mine = rows.filter(F.col("k") == k).groupBy("start").agg(F.min("conv_id").alias("parent_conv_id"))
    real = rows.filter(F.col("k") == k - 1).groupBy(F.col("fp").alias("start")).agg(F.min("conv_id").alias("real"))
    table = mine.join(real, "start").select("parent_conv_id", "real")
    topmost = attach(level.filter("depth = 2"), table, ["parent_conv_id"])
    renamed = topmost.withColumn("parent_conv_id", F.col("real")).select(*level.columns)
    return level.filter("depth > 2").unionByName(renamed)


def _below(rows: DataFrame, k: int, level: DataFrame) -> DataFrame:
    """fp of the block before -> what the blocks k add below its end. A depth-1 node of the level is
    found by its smallest member."""
    start = rows.filter(F.col("k") == k).groupBy("start").agg(F.min("conv_id").alias("conv_id"))
    tops = level.filter("depth = 1").select(
        "conv_id", F.col("n_children").alias("more_children"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
    return start.join(tops, "conv_id").select(F.col("start").alias("fp"), "more_children", "more_leaves", "more_saved")
