"""Documents whose word-shingle sets are similar (Jaccard, at least a given percentage), by a grouped
prefix join, and the groups they form.

Words are lower-cased (A to Z only); a set holds the distinct shingles of a text, or its whole word
sequence if it has fewer words than a shingle. ``Rule`` has the words of a shingle and the percentage:
five words and 80 by default. Steps:

1. Shingles are ordered by how many documents hold them, rarest first. What is counted is a fixed
   number of hash cells (``CELLS``), so the counts stay small; any fixed order is right, a good one only
   keeps frequent shingles out of the prefixes.
2. Texts with equal sets are one node. A node of n shingles can only be similar to one that shares a
   shingle among its first n - ceil(p n) + 1 (its prefix). Nodes with equal prefix and size are one
   group: what filters one of them by size and position filters all.
3. Groups that share a prefix shingle are candidates. Where few share it, all their pairs are. Where
   many do, each is first paired with ``HUBS`` of them only, those with the fewest rarer shingles.
4. Pairs pass a bound on the overlap (shingles per hash class), are expanded to members and verified on
   whole sets. Links give components.
5. For shingles that many groups share, the pairs of groups in different components that step 3 left
   out follow, so no link between components is missed. In a family of thousands of near copies
   nearly all are in one component by then.

So a component is exact, though not every link in it is looked at. Null, empty or blank text: an empty
set, linked with nothing. Repeated rows and copies share a node. A null doc_id is never the smallest
of a component unless all are null. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Batches, free_name, in_slices, keep_only, keyed_texts, scratch, staged
from .components import components
from .hashing import run_hashes, set_fingerprint, word_hashes

CELLS = 1 << 20
#: Cells per row while counts are added up.
SLICE = 1 << 10
#: A prefix shingle of more groups than this is joined through hubs first. Also the most members of a
#: group; more are indexed one by one.
FEW = 8
HUBS = 4
CLASSES = 64
#: Rows up to which the keys of documents to be read again are broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    shingle: int = 5
    percent: int = 80

    def shingles(self, text: str) -> np.ndarray:
        """Sorted hashes of the distinct shingles."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        size = min(self.shingle, len(words))
        return np.unique(run_hashes(word_hashes(words), size, seed=size))

    def needed(self, n, m):
        """Least overlap of similar sets of n and m shingles (ceiling of an exact fraction)."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def prefix_length(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def can_match(self, n: Column, m: Column, i: Column, j: Column) -> Column:
        """For sets of n and m shingles whose first shared one is at positions i and j."""
        room = F.least(n - i, m - j)
        return (100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & ((100 + self.percent) * room >= self.percent * (n + m))


def cell_counts(texts: DataFrame, rule: Rule) -> np.ndarray:
    """Number of documents per hash cell of their shingles: CELLS numbers, whatever the input."""
    def count(batches: Batches) -> Batches:
        keep_only("similar")
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in in_slices(batches):
            for text in batch.column("text").to_pylist():
                np.add.at(total, (rule.shingles(text) % np.uint64(CELLS)).astype(np.int64), 1)
        used = [i for i in range(CELLS // SLICE) if total[i * SLICE:(i + 1) * SLICE].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([total[i * SLICE:(i + 1) * SLICE].tobytes() for i in used], pa.binary())], names=["slice", "counts"])

    def add(batches: Batches) -> Batches:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                totals[i] = totals.get(i, 0) + np.frombuffer(raw, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(totals.keys(), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    rows = texts.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).toArrow()
    out = np.zeros(CELLS, dtype=np.int64)
    for i, raw in zip(rows.column("slice").to_pylist(), rows.column("counts").to_pylist()):
        out[i * SLICE:(i + 1) * SLICE] = np.frombuffer(raw, dtype=np.int64)
    return out


def sets(texts: DataFrame, rule: Rule) -> DataFrame:
    """Per row of doc_id, text, tag: doc_id, tag, n, node (fingerprint of the set; null if empty), group (fingerprint of prefix and
    size), prefix (shingle hashes in order), classes (shingles per class)."""
    shared = texts.sparkSession.sparkContext.broadcast(cell_counts(texts, rule))

    def run(batches: Batches) -> Batches:
        keep_only("similar")
        counts = shared.value
        for batch in in_slices(batches):
            out = []
            for key, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text"))):
                hashes = rule.shingles(text)
                n = len(hashes)
                if not n:
                    out.append((key, tag, 0, None, None, [], b""))
                    continue
                frequent = counts[(hashes % np.uint64(CELLS)).astype(np.int64)]
                length = rule.prefix_length(n)
                bound = np.partition(frequent, length - 1)[length - 1]
                low = frequent <= bound
                order = np.lexsort((hashes[low], frequent[low]))[:length]
                prefix = hashes[low][order]
                classes = np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=CLASSES)
                out.append((key, tag, n, set_fingerprint(hashes), set_fingerprint(np.append(prefix, np.uint64(n))),
                            prefix.view(np.int64), classes.astype("<u4").tobytes()))
            columns = list(zip(*out)) if out else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["doc_id", "tag", "n", "node", "grp", "prefix", "classes"])

    return texts.mapInArrow(run, "doc_id long, tag long, n long, node binary, grp binary, prefix array<long>, classes binary")


def enough(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of a and b (with their sizes and classes) whose overlap can be large enough."""
    def run(batches: Batches) -> Batches:
        for batch in in_slices(batches):
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(-1, CLASSES) for c in ("ca", "cb"))
            need = rule.needed(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            keep = pa.array(np.minimum(left, right).sum(axis=1, dtype=np.int64) >= need)
            yield batch.select(["a", "b"]).filter(keep)
    return pairs.mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b, sa, sb: sorted set hashes) that are similar enough."""
    def run(batches: Batches) -> Batches:
        for batch in in_slices(batches):
            keep = []
            for sa, sb in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                left, right = np.frombuffer(sa, dtype="<u8"), np.frombuffer(sb, dtype="<u8")
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= rule.percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return pairs.mapInArrow(run, "a binary, b binary")


def whole_sets(texts: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """node, hashes of the wanted nodes (node, doc_id of one of its documents), from the texts."""
    def run(batches: Batches) -> Batches:
        for batch in in_slices(batches):
            found = [rule.shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_fingerprint(s) for s in found], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())],
                names=["node", "hashes"])

    keys = staged(wanted.select(F.col("doc_id").alias("wanted_id")).distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    chosen = texts.join(keys, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    # rows that share a doc_id may have other texts: only wanted nodes stay, each once
    return chosen.mapInArrow(run, "node binary, hashes binary").join(
        wanted.select(F.col("node").alias("w")), F.col("node") == F.col("w"), "left_semi").dropDuplicates(["node"])


def links_of(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Verified links among candidate pairs of nodes (a, b)."""
    info = nodes.select("node", "n", "classes")
    left = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("classes").alias("ca"))
    right = info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("classes").alias("cb"))
    close = staged(enough(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ca", "cb"), rule))
    wanted = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    whole = staged(whole_sets(texts, nodes.join(wanted, "node", "left_semi").select("node", "doc_id"), rule))
    return verified(close.join(whole.select(F.col("node").alias("a"), F.col("hashes").alias("sa")), "a").join(
        whole.select(F.col("node").alias("b"), F.col("hashes").alias("sb")), "b").select("a", "b", "sa", "sb"), rule)


def similar_nodes(texts: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """node, root of every node that is linked to another. ``rows`` is the written result of ``sets``."""
    can_match = rule.can_match
    nodes = staged(rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("classes").alias("classes"),
        F.first("prefix").alias("prefix")))
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("members"))
    # a unit is a group, or a node of a large one; two units with one number would only add candidates
    unit = F.xxhash64(F.when(F.col("members") <= FEW, F.col("grp")).otherwise(F.col("node")))
    units = nodes.select("node", "n", "grp", "prefix").join(sizes, "grp").withColumn("unit", unit)
    one = F.col("members") > FEW
    indexed = staged(units.withColumn("at_grp", F.when(one, F.col("node")).otherwise(F.col("grp"))).groupBy("at_grp", "unit").agg(
        F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix")).select("unit", "n", "prefix"))
    members = staged(units.select("unit", "node", "members"))

    postings = indexed.select("unit", "n", F.posexplode("prefix").alias("at", "token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    index = staged(postings.join(shared, "token"))

    few = index.filter(F.col("k") <= FEW).select("token", "unit", "n", "at")
    other = few.select(F.col("token").alias("t"), F.col("unit").alias("v"), F.col("n").alias("m"), F.col("at").alias("j"))
    direct = few.join(other, (F.col("token") == F.col("t")) & (F.col("unit") < F.col("v"))).filter(
        can_match(F.col("n"), F.col("m"), F.col("at"), F.col("j"))).select("unit", "v")
    often = index.filter(F.col("k") > FEW).select("token", "unit", "n", "at")
    # few rarer shingles in front of the shared one: little of the text is its own, so most of a family of
    # near copies is similar to it
    hub = lambda k: F.min(F.struct("at", F.xxhash64("unit", F.lit(k)).alias("h"), "unit", "n"))
    hubs = often.groupBy("token").agg(F.array_distinct(F.array(*(hub(k) for k in range(HUBS)))).alias("hubs"))
    by_hub = often.join(hubs, "token").select("unit", "n", "at", F.explode("hubs").alias("h")).filter(
        (F.col("unit") != F.col("h.unit")) & can_match(F.col("n"), F.col("h.n"), F.col("at"), F.col("h.at"))).select(
        F.least("unit", "h.unit").alias("unit"), F.greatest("unit", "h.unit").alias("v"))

    def expanded(unit_pairs: DataFrame) -> DataFrame:
        pairs = unit_pairs.join(members.select("unit", F.col("node").alias("x")), "unit").join(
            members.select(F.col("unit").alias("v"), F.col("node").alias("y")), "v")
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    small = members.filter((F.col("members") > 1) & (F.col("members") <= FEW)).select("unit", F.col("node").alias("x"))
    inside = small.join(small.select("unit", F.col("x").alias("y")), "unit").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = staged(expanded(direct.unionByName(by_hub).distinct()).unionByName(inside).distinct())
    links = staged(links_of(texts, nodes, pairs, rule))
    found = components(links)

    # what hubs left out: groups in different components that share a frequent prefix shingle
    labelled = members.join(found, "node", "left").groupBy("unit").agg(
        F.min(F.coalesce("root", "node")).alias("lo"), F.max(F.coalesce("root", "node")).alias("hi")).select(
        "unit", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("label"))
    many = often.join(labelled.select(F.col("unit"), F.coalesce(F.xxhash64("label"), F.col("unit")).alias("label")), "unit")
    mixed = many.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(F.col("token").alias("mixed_token"))
    open_rows = staged(many.join(mixed, F.col("token") == F.col("mixed_token"), "left_semi"))
    second = open_rows.select(F.col("token").alias("t"), F.col("unit").alias("v"), F.col("n").alias("m"), F.col("at").alias("j"), F.col("label").alias("label2"))
    rest = open_rows.join(second, (F.col("token") == F.col("t")) & (F.col("unit") < F.col("v")) & (F.col("label") != F.col("label2"))
                          & can_match(F.col("n"), F.col("m"), F.col("at"), F.col("j"))).select("unit", "v").distinct()
    more = staged(links_of(texts, nodes, staged(expanded(rest).join(pairs, ["a", "b"], "left_anti")), rule))
    return components(links.unionByName(more))


def groups(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), tag (hash of the
    text) and root (what all rows of a component share; null without words)."""
    texts = keyed_texts(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    rows = staged(sets(texts, rule))
    roots = similar_nodes(texts, rows, rule)
    first = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    by_root = first.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = by_root.groupBy("root").agg(F.min("least").alias("component_id"))
    names = by_root.join(least, "root").select(F.col("node").alias("of"), "component_id", "root")
    return rows.select("doc_id", "tag", F.col("n").alias("n_shingles"), "node").join(names, F.col("node") == F.col("of"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "tag", "root")


def first_of_each(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those similar to another that comes first by doc_id (nulls last), then by
    a hash of the text. Rows without words all stay; of identical rows one stays. The tables of the join are
    deleted once the keys to keep are written."""
    tag, keep_id, keep_tag = (free_name(docs, n) for n in ("tag__", "keep__id", "keep__tag"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    with scratch(docs.sparkSession):
        found = groups(docs, rule, id_col, text_col).filter("root is not null").groupBy("root").agg(first.alias("f"))
        keep = staged(found.select(F.col("f.doc_id").alias(keep_id), F.col("f.tag").alias(keep_tag)), lasting=True)
    words = F.regexp_like(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    tagged = docs.filter(words).withColumn(tag, F.xxhash64(text_col))
    kept = tagged.join(keep, F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(tag) == F.col(keep_tag)), "left_semi")
    return kept.dropDuplicates([id_col, tag]).drop(tag).unionByName(docs.filter(~words))
