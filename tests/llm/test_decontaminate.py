import math
import re
from collections import Counter

from pyspark.sql import functions as F

from riskframe.llm import decontaminate as dc
from llm_helpers import docs, odd_texts, real_texts


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(ws):
    return [" ".join(ws[i:i + 5]) for i in range(len(ws) - 4)]


def brute(texts, items):
    """Every item-sized window of every document against every item."""
    item_words = {k: words(t) for k, t in items.items() if len(words(t)) >= 5}
    df = Counter(s for ws in item_words.values() for s in set(shingles(ws)))
    q = lambda s: min(7, 1 + math.floor(math.log2(len(item_words) / df[s]))) if s in df else 7
    found = {}
    for d, text in enumerate(texts):
        ws = words(text)
        for k, iw in item_words.items():
            c = Counter(shingles(iw))
            for a in range(len(ws) - 4):
                w = Counter(shingles(ws[a:a + len(iw)]))
                both = sum(min(n, c[s]) * q(s) for s, n in w.items() if s in c)
                if both:
                    sim = both / (sum(n * q(s) for s, n in w.items()) + sum(n * q(s) for s, n in c.items()) - both)
                    if sim >= 0.8:
                        found[d, k] = max(found.get((d, k), 0), round(sim, 6))
    return found


def table(spark, items):
    return spark.createDataFrame(list(items.items()), "item_id long, text string")


def test_same_as_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(12).collect()
    items = {r["item_id"]: r["text"] for r in rows} | {500: "short item", 501: None, 502: rows[0]["text"], 503: "one two three four five"}
    passage = rows[3]["text"]
    one_off = passage.split()
    one_off[-2] = "changed"
    texts = odd_texts()[:-4] + real_texts(spark, sf, 25) + [
        passage, "before it all " + passage + " and after", " ".join(one_off), passage.upper().replace(" ", "  "),
        " ".join(passage.split()[: len(passage.split()) // 2]), passage + " x " + passage, "say one two three four five six", rows[0]["text"]]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.matches(docs(spark, texts), table(spark, items)).collect()}
    want = brute(texts, items)
    assert len(want) > 6
    assert {k: want[k] for k in got} == got  # nothing false, and similarities exact
    # the radius is a guarantee on fingerprints; near the threshold a similar pair may lie outside
    assert all(k in got for k, s in want.items() if s >= 0.9)
    left = {r["doc_id"] for r in dc.clean(docs(spark, texts), table(spark, items)).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}


def test_index_finds_all_within_radius(spark):
    pairs = spark.range(400).select(F.xxhash64("id").alias("fp"), F.col("id")).withColumn(
        "other", F.expr("fp ^ (shiftleft(1L, cast(id % 64 as int)) | shiftleft(1L, cast(id * 7 % 64 as int)) | cast(id * 2654435761 % 4096 as long))"))
    rows = pairs.select("fp", "other", dc.blocks("fp").alias("a"), dc.blocks("other").alias("b")).collect()
    for r in rows:
        if bin((r["fp"] ^ r["other"]) & (2**64 - 1)).count("1") <= dc.RADIUS:
            assert any(bin(x["value"] ^ y["value"]).count("1") <= dc.RADIUS // dc.BLOCKS for x, y in zip(r["a"], r["b"]))


def test_empty_tables_and_clashing_columns(spark):
    item = {1: "a b c d e f g h"}
    some = docs(spark, ["zz a b c d e f g h", "other"])
    assert dc.matches(some.filter("false"), table(spark, item)).count() == 0
    assert dc.matches(some, table(spark, item).filter("false")).count() == 0
    assert dc.clean(some, table(spark, item).filter("false")).count() == 2
    clash = some.withColumn("item_id", F.lit("q")).withColumn("words", F.lit(1)).withColumn("window", F.lit(2)).withColumn("found_id", F.lit(3))
    assert [r["doc_id"] for r in dc.matches(clash, table(spark, item)).collect()] == [0]
    null_key = spark.createDataFrame([(None, item[1]), (None, None), (4, "clean")], "doc_id long, text string")
    left = dc.clean(null_key.withColumn("tag__", F.lit("mine")).withColumn("found__id", F.lit(1)), table(spark, item))
    assert left.columns == ["doc_id", "text", "tag__", "found__id"]
    assert sorted((str(r["doc_id"]), r["text"], r["tag__"]) for r in left.collect()) == [("4", "clean", "mine"), ("None", None, "mine")]


def test_clean_rows_stay_beside_contaminated_ones_of_their_key(spark):
    item = "a b c d e f g h"
    rows = [(None, item), (None, "nothing of it"), (None, ""), (7, "x " + item), (7, "also clean"), (7, "also clean"), (8, item), (9, "clean")]
    got = dc.clean(spark.createDataFrame(rows, "doc_id long, text string").withColumn("found_id", F.lit(3)), table(spark, {1: item}))
    assert got.columns == ["doc_id", "text", "found_id"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [
        ("7", "also clean"), ("7", "also clean"), ("9", "clean"), ("None", ""), ("None", "nothing of it")]
    assert [r["item_id"] for r in dc.matches(spark.createDataFrame(rows, "doc_id long, text string"), table(spark, {1: item})).filter("doc_id = 7").collect()] == [1]


def test_fingerprints_of_long_items(spark):
    # equal shingles all vote alike, so any number of them has the fingerprint of one
    same = spark.createDataFrame([(1, ["a"] * 5), (2, ["a"] * 20_000)], "item long, words array<string>")
    mixed = spark.range(1).select(F.lit(3).cast("long").alias("item"), F.transform(F.sequence(F.lit(1), F.lit(9_800)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("words"))
    weights = spark.createDataFrame([], "h long, q long")
    got = {r["item"]: r for r in dc.fingerprints(same.unionByName(mixed), "item", weights).collect()}
    assert got[1]["fp"] == got[2]["fp"] and got[2]["total"] == 7 * 19_996
    hashes = mixed.select("words", F.explode(F.sequence(F.lit(0), F.lit(9_795))).alias("at")).select(F.xxhash64(dc.shingle_hash("words", F.col("at")), F.lit(3)).alias("h")).collect()
    votes = [sum(r["h"] >> b & 1 for r in hashes) * 2 > len(hashes) for b in range(64)]
    assert [bool(got[3]["fp"] >> b & 1) for b in range(64)] == votes
