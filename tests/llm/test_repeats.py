import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskframe.llm import repeats
from llm_helpers import docs, odd_texts, real_texts


def brute(rows):
    """rows: (doc_id, text); the remaining words of each row."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, ws in words:
        for a in range(len(ws) - 49):
            if i is not None:
                key = tuple(ws[a:a + 50])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for a in range(len(ws) - 49):
            if i is not None and least[tuple(ws[a:a + 50])] < i:
                gone.update(range(a, a + 50))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1)).withColumn("tag", F.lit("x")).repartition(4)
    got = [tuple(r) for r in repeats.remove(df).select("doc_id", "n_words", "n_removed", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


@pytest.mark.parametrize("group", [200, 1_000_000])
def test_same_as_brute_force(spark, sf, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP_WORDS", group)
    rng = random.Random(5)
    pool = [[f"p{k}w{rng.randrange(99)}" for _ in range(n)] for k, n in enumerate((49, 50, 51, 75, 120))]
    texts = odd_texts() + real_texts(spark, sf, 60)
    for k in range(60):
        parts = [[f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(70))], rng.choice(pool), [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]]
        texts.append(" ".join(sum(parts, [])))
    texts += ["same " * 130, "same " * 49, "same " * 300, " ".join(pool[4][30:100]), " ".join(pool[4][:49])] * 2
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[-1]), (None, " ".join(pool[4])), (7, " ".join(pool[4])), (7, "first " + " ".join(pool[4])), (7, "first " + " ".join(pool[4]))]
    got = check(spark, rows)
    assert sum(r[2] for r in got) > 2000


def test_empty_and_short(spark):
    assert repeats.remove(docs(spark, ["x"]).filter("false")).count() == 0
    check(spark, [(1, "a b"), (2, "a b"), (3, None)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2000)), max_size=80))
def test_packing_of_positions(entries):
    entries = sorted(set(entries))
    doc, pos = np.array([e[0] for e in entries], np.int64), np.array([e[1] for e in entries], np.int64)
    docs_, *rest = repeats.pack(doc, pos)
    number, back = repeats.unpack(*rest)
    assert back.tolist() == pos.tolist() and docs_[number].tolist() == doc.tolist() if len(entries) else True


def test_rolling_hash_depends_on_the_window_only():
    words = np.array([3, 1, 4, 1, 5, 3, 1, 4, 1, 5], dtype=np.uint64)
    h = repeats.rolling(words, 5)
    assert h[0] == h[5] and len(set(h.tolist())) == 5
