import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskframe.llm import components, similar
from riskframe.session import shared_dir
from llm_helpers import docs, odd_texts, real_texts


RULES = {(3, 90): similar.Rule(3, 90), (5, 80): similar.Rule()}


def brute_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(texts, k=3, percent=90):
    sets, root = [brute_set(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def families(rng, n_families, copies, length=70, changes=2):
    texts = []
    for f in range(n_families):
        base = [f"w{f}x{rng.randrange(400)}" for _ in range(length)]
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randrange(changes + 1)):
                words[rng.randrange(length)] = f"new{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed, few, hubs, rule", [(1, 8, 4, (3, 90)), (2, 2, 1, (5, 80))])
def test_same_components_as_brute_force(spark, sf, monkeypatch, seed, few, hubs, rule):
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "HUBS", hubs)
    rng = random.Random(seed)
    texts = odd_texts() + real_texts(spark, sf, 40) + families(rng, 2, 60) + families(rng, 12, 4) + families(rng, 1, 40, 30, 1)
    texts += ["a b", "A  B", "a", "one line that many share", "one line that many share"] * 3
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar.groups(docs(spark, texts), RULES[rule]).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, *rule)


def test_hubs_alone_would_miss_links(spark, monkeypatch):
    """A chain of near copies: neighbours are similar, ends are not."""
    monkeypatch.setattr(similar, "FEW", 2)
    monkeypatch.setattr(similar, "HUBS", 1)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(25):
        words[4 * i % 100] = f"changed{i}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar.groups(docs(spark, texts), RULES[3, 90]).collect()}
    assert [got[i] for i in range(25)] == brute(texts)
    assert got[24][1] == 0


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame(
        [(5, "x y z a", 1), (2, "x y z a", 2), (2, "x y z a", 3), (7, None, 4), (7, None, 4), (8, "  ", 5), (9, "other words here", 6), (9, "the same number but not similar", 7),
         (None, "no number a b c", 8), (None, "nor this one d e f", 9), (None, "nor this one d e f", 10), (None, "x y z a", 11)],
        "doc_id long, text string, node int").withColumn("root", F.lit("r"))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in similar.first_of_each(df).collect())
    assert got == [(-1, "no number a b c"), (-1, "nor this one d e f"), (2, "x y z a"), (7, ""), (7, ""), (8, "  "), (9, "other words here"),
                   (9, "the same number but not similar")]
    assert similar.groups(df.filter("false")).count() == 0


def test_components_of_links(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_columns_named_like_helpers_stay(spark):
    text = "one two three four five six seven eight"
    rows = spark.createDataFrame([(1, text, "a", 5), (2, text, "b", 6), (3, None, "c", 7)], "doc_id long, text string, tag__ string, keep__id int")
    left = similar.first_of_each(rows)
    assert left.columns == rows.columns
    assert sorted(tuple(r) for r in left.select("doc_id", "tag__", "keep__id").collect()) == [(1, "a", 5), (3, "c", 7)]


def test_first_of_each_leaves_only_the_keys_behind(spark, sf):
    """The tables of the join are gone, and the result can still be read, twice."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    df = spark.read.parquet(f"{sf}/documents.parquet")
    kept = similar.first_of_each(df)
    assert len(set(folder.iterdir()) - before) == 1
    ids = [sorted(r["doc_id"] for r in kept.select("doc_id").collect()) for _ in range(2)]
    assert ids[0] == ids[1] and 0 < len(ids[0]) <= df.count()
