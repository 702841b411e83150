import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm_helpers import docs, odd_texts
from riskframe.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_vocabulary(rows, least=7):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= 2}


def plain_near(words):
    """By patterns with one open place, independent of the composition."""
    forms = {}
    for w in words:
        for i in range(len(w)):
            forms.setdefault((i, w[:i] + w[i + 1:]), set()).add(w)
    near = {w: set() for w in words}
    for same in forms.values():
        for a, b in itertools.permutations(same, 2):
            near[a].add(b)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1:]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def plain_variants(words):
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def as_set(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", max_size=7), max_size=40))
def test_composition_finds_every_pair_once(words):
    found = list(spelling.OneEdit(spelling.Acceptor(sorted(words))).pairs())
    want = {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p)}
    assert len(found) == len(want)
    assert {frozenset((u, v)) for u, v, _ in found} == want
    for u, v, at in found:
        assert u[:at] == v[:at] and u[at:at + 1] != v[at:at + 1]


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor(sorted(a + b for a in ("x", "y", "zz") for b in ("ing", "ed", "")))
    assert len(acceptor.final) == len({(f, tuple(a.items())) for f, a in zip(acceptor.final, acceptor.arcs)})
    assert acceptor.arcs[acceptor.start]["x"] == acceptor.arcs[acceptor.start]["y"]


@pytest.mark.parametrize("most", [12, 20_000])
def test_pairs_of_a_dense_vocabulary(spark, most):
    """Partitions of any size give the same pairs: small bounds force several rounds."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))): rng.randint(2, 9) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    got = {(r["word"], r["other"]) for r in spelling.pairs(df, most).collect()}
    near = plain_near(words)
    assert got == {(w, v) for w, vs in near.items() for v in vs}
    counts = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near(df, most).collect()}
    assert counts == {w: (len(v), *min(((u, words[u]) for u in v), key=lambda x: (-x[1], x[0]))) for w, v in near.items() if v}


def test_supplied_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    words = plain_vocabulary([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert len(words) > 500
    assert as_set(spelling.variants(df)) == plain_variants(words)


def test_odd_rows_and_chains_of_forms(spark):
    chain = ["testinga"] * 400 + ["testingab"] * 30 + ["testingabc"] * 3 + ["Testingabcd "] * 0
    texts = odd_texts() + [" ".join(chain), "ÀÉÎõüÿ×÷abc ÀÉÎõüÿ×÷abc ÀÉÎõüÿ×÷abd", "q" * 40_000 + " " + "q" * 40_000, "lettersétterslong" * 2,
                           "equalaa equalaa equalab equalab equalac equalac", "LONG" * 300_000, "Wordword, wordword; wordword9wordWord"]
    frame = docs(spark, texts).withColumns({c: F.lit(1) for c in ("word", "n", "left", "cls")})
    frame = frame.unionByName(frame.limit(0)).unionByName(frame.filter("doc_id = 20").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [*enumerate(texts), (None, texts[20])]
    assert as_set(spelling.variants(frame)) == plain_variants(plain_vocabulary(rows))


def test_empty_table(spark):
    got = spelling.variants(docs(spark, ["x"]).limit(0))
    assert got.columns == COLUMNS and got.collect() == []


def test_slices_lose_no_word():
    text = "one two  three,four five " * 50 + "x" * 300 + " y"
    parts = list(spelling.slices(text, 16))
    assert "".join(parts) == text
    assert [w for p in parts for w in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)
