"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming lookup, then
exact weighted-shingle similarity. DataFrame expressions only.

Words are runs of letters and digits, lower-cased; shingles are five words. A window has as many words
as a benchmark item and begins at a shingle that occurs in an item of that length: any passage similar
to an item shares a shingle with it, and moving the window to the first shared one loses none of them.
Windows with equal words are fingerprinted once, however many documents hold them.

A fingerprint has 64 bits, each the weighted majority of the shingles' hash bits; a shingle weighs more
the fewer items it occurs in. Fingerprints are compared in four blocks of 16 bits. Two of them within
``RADIUS`` = 15 differ by at most 3 bits in some block, so an index that holds each item's blocks with up
to 3 bits changed finds all of them. What is found is verified: sum of the smaller weights over sum
of the larger ones, at least ``SIMILARITY``.

Null or empty text, and items of fewer than five words, match nothing. ``matches`` counts rows with
one doc_id as one document, ``clean`` takes rows one by one. Repeated items are reported each. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, staged

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCKS, BLOCK_BITS = 15, 4, 16
#: Shingle weights run from 1 to this.
MAX_WEIGHT = 7
#: Rows up to which a table made from the benchmark (or of document keys) is broadcast; above, it is
#: joined by shuffle. 1,000,000 rows of two numbers are about 16 MB.
BROADCAST_ROWS = 1_000_000

_NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _NOT_WORD), lambda w: w != "")


def shingle_hash(array: str, at: Column) -> Column:
    return F.xxhash64(*(F.get(F.col(array), at + i) for i in range(SHINGLE)))


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count says so. Pass a written table."""
    return F.broadcast(df) if df.count() <= limit else df


def weight(q: str = "q") -> Column:
    """A shingle of no item has the highest weight."""
    return F.coalesce(F.col(q), F.lit(MAX_WEIGHT)).cast("long")


def counted(keyed: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """key, words -> key, shingle, n, q: counts and weights of the shingles of each key."""
    rows = keyed.select(key, "words", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE)).alias("at")).select(
        key, F.array_join(F.slice("words", F.col("at") + 1, SHINGLE), " ").alias("shingle"), shingle_hash("words", F.col("at")).alias("h"))
    return rows.groupBy(key, "shingle", "h").agg(F.count("*").alias("n")).join(weights, "h", "left").select(key, "shingle", "n", weight().alias("q"))


def fingerprints(keyed: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """key, words -> key, fp, total. Two bits of a shingle's hash at a time are spread into lanes of 32
    bits, so 32 sums hold the votes of all 64 bits. A lane holds 300 million shingles of the highest
    weight, more than an array can have words. A row's shingles are summed where they are made; only the
    sums are exchanged."""
    votes = keyed.select(key, "words", F.posexplode("words").alias("at", "word")).filter(F.col("at") <= F.size("words") - SHINGLE).select(
        key, shingle_hash("words", F.col("at")).alias("h")).join(weights, "h", "left").select(key, F.xxhash64("h", F.lit(3)).alias("h"), weight().alias("q"))
    h, q = F.col("h"), F.col("q")
    lanes = [
        F.sum((((F.shiftrightunsigned(h, 2 * g).bitwiseAND(F.lit(3))) * F.lit(0x0000000080000001)).bitwiseAND(F.lit(0x0000000100000001))) * q)
        .alias(f"v{g}") for g in range(32)
    ]
    votes = votes.groupBy(key).agg(*lanes, F.sum("q").alias("total"))
    bit = lambda g, i: F.when(
        F.shiftrightunsigned(f"v{g}", 32 * i).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), 2 * g + i)).otherwise(F.lit(0).cast("long"))
    fp = bit(0, 0)
    for g in range(32):
        for i in range(2):
            if g or i:
                fp = fp.bitwiseOR(bit(g, i))
    return votes.select(key, fp.alias("fp"), "total")


def blocks(fp: str) -> Column:
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, BLOCK_BITS * b).bitwiseAND(F.lit(0xFFFF)).alias("value")) for b in range(BLOCKS)))


def located(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per similar window and item: doc_id, tag (hash of the row's text), item_id, similarity, at, n."""
    known = staged(items.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("words"), F.monotonically_increasing_id().alias("item"))
                   .filter(F.size("words") >= SHINGLE))
    n_items = known.count()
    item_rows = staged(known.select("item", "words", F.size("words").alias("w_words"), F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE)).alias("at")).select(
        "item", shingle_hash("words", F.col("at")).alias("anchor"), "w_words").distinct())
    weights = staged(item_rows.groupBy("anchor").count().select(
        F.col("anchor").alias("h"), F.least(F.lit(MAX_WEIGHT), 1 + F.floor(F.log2(F.lit(float(max(1, n_items))) / F.col("count")))).alias("q")))
    item_shingles = staged(counted(known.select("item", "words"), "item", weights))
    item_prints = staged(fingerprints(known.select("item", "words"), "item", small_enough(weights)))
    anchors = staged(item_rows.select("anchor", "w_words").distinct())

    # every shingle of every document against the shingles of the items
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), words(F.col(text_col)).alias("words")).filter(
        F.size("words") >= SHINGLE)
    placed = cut.select("doc_id", "tag", "words", F.posexplode("words").alias("at", "word")).filter(F.col("at") <= F.size("words") - SHINGLE)
    hit = placed.select("doc_id", "tag", "words", "at", shingle_hash("words", F.col("at")).alias("h")).join(small_enough(anchors), F.col("h") == F.col("anchor"))
    hits = staged(hit.select("doc_id", "tag", F.col("at").cast("long").alias("at"), F.slice("words", F.col("at") + 1, F.col("w_words")).alias("words")).withColumn(
        "window", F.unhex(F.sha2(F.array_join("words", " ").cast("binary"), 256))))
    windows = staged(hits.groupBy("window").agg(F.first("words").alias("words")))

    prints = fingerprints(windows, "window", small_enough(weights)).select("window", F.col("fp").alias("w_fp"), F.col("total").alias("w_total"))
    changes = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << BLOCK_BITS) - 1).cast("long")), lambda x: F.bit_count(x) <= RADIUS // BLOCKS))
    index = item_prints.select("item", "fp", "total", F.explode(blocks("fp")).alias("b")).select("item", "fp", "total", "b", changes.alias("change")).select(
        "item", "fp", "total", "b.block", F.col("b.value").bitwiseXOR(F.col("change")).alias("value"))
    near = staged(prints.select("window", "w_fp", "w_total", F.explode(blocks("w_fp")).alias("b")).select(
        "window", "w_fp", "w_total", "b.block", "b.value").join(index, ["block", "value"]).filter(
        F.bit_count(F.col("w_fp").bitwiseXOR(F.col("fp"))) <= RADIUS).select("window", "w_total", "item", "total").distinct())

    candidates = windows.join(near.select("window").distinct(), "window", "left_semi")
    other = item_shingles.select(F.col("item").alias("i_item"), F.col("shingle").alias("i_shingle"), F.col("n").alias("i_n"))
    shared = near.join(counted(candidates, "window", weights), "window").join(other, (F.col("item") == F.col("i_item")) & (F.col("shingle") == F.col("i_shingle"))).groupBy(
        "window", "item", "w_total", "total").agg(F.sum(F.least("n", "i_n") * F.col("q")).alias("both"))
    verified = shared.withColumn("similarity", F.col("both") / (F.col("w_total") + F.col("total") - F.col("both"))).filter(F.col("similarity") >= similarity)
    named = verified.join(known.select(F.col("item").alias("k_item"), "item_id"), F.col("item") == F.col("k_item")).select("window", "item_id", "similarity")
    return hits.select("doc_id", "tag", "at", "window", F.size("words").alias("n")).join(named, "window").drop("window")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, start_word (of the most
    similar window, the first of equal ones), n_words."""
    return located(docs, items, id_col, **options).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("at")).alias("before"), "n")).alias("best")).select(
        "doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.before")).alias("start_word"), F.col("best.n").cast("long").alias("n_words"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows without any match, unchanged. Rows that share a doc_id, or have none, are told apart by a
    hash of their text. A row whose text is null matches nothing and stays. Columns of any name stay."""
    tag = free_name(docs, "tag__")
    found_id, found_tag = free_name(docs, "found__id"), free_name(docs, "found__tag")
    found = staged(located(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias(found_id), F.col("tag").alias(found_tag)).distinct())
    same = F.col(id_col).eqNullSafe(F.col(found_id)) & (F.col(tag) == F.col(found_tag))
    return docs.withColumn(tag, F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))).join(small_enough(found), same, "left_anti").drop(tag)
