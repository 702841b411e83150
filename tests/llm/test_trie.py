import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskframe.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    by_id = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            by_id.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [t[2:] for t in sorted(turns)] for c, turns in by_id.items()}
    out = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = plain.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[k] for k in below)
    out = set()
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids.get(node, [])), leaves[node],
                 saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def as_set(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def sample(seed, n=260, words=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        length = rng.choice([1, 2, 3, longest]) if c % 7 else longest
        for t in range(length):
            rows.append((c * rng.choice([1, 1, 1, 3]) if False else c, t, rng.choice(["user", "assistant"]) if t > 4 else "user", "ab"[rng.randrange(2)] * rng.randint(1, words)))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_equals_a_plain_trie(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert as_set(trie.nodes(trie.rebuilt(df))) == plain_nodes(rebuilt(rows))


def test_supplied_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert as_set(trie.nodes(trie.rebuilt(df))) == plain_nodes(rebuilt(rows))


@pytest.mark.parametrize("block", [2, 5])
def test_blocks_do_not_change_the_result(spark, block):
    rows = sample(3, n=120, longest=13)
    df = spark.createDataFrame(rows, TURNS)
    assert as_set(trie.nodes(trie.rebuilt(df), block)) == plain_nodes(rebuilt(rows))


def test_copies_and_one_long_conversation(spark):
    rows = [(c, t, "user", "hello" * (t + 1)) for c in range(400, 600) for t in range(3)]
    rows += [(c, t, "user", f"turn {t}") for c in (700, 701, 702) for t in range(900)]
    df = spark.createDataFrame(rows, TURNS)
    want = plain_nodes(rebuilt(rows))
    assert as_set(trie.nodes(trie.rebuilt(df))) == want
    assert as_set(trie.nodes(trie.rebuilt(df), 64)) == want


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [
        (0, 0, "user", "x"), (0, None, None, None), (0, 1, "a", ""), (0, 1, "a", ""), (None, 0, "user", "lost"),
        (1, 5, "user", None), (1, 5, None, "user"), (2, 0, "us", "er"), (3, 0, "u", "ser"), (100, 0, "user", ""), (100, 0, "user", ""),
        (-105, 0, "user", "below"), (7, 0, "user", "long " * 50_000), (8, 0, "user", "long " * 50_000),
    ]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("mine") for c in ("pos", "digest", "fp", "key", "depth", "k")})
    want = rebuilt([r for r in rows if r[0] != -105])
    # the remainder of a negative id is taken towards zero: -105 belongs to -100, which is absent
    h = zlib.crc32(b"-105") % 6
    want[-105] = [] if h else [("user", "below")]
    assert as_set(trie.nodes(trie.rebuilt(df))) == plain_nodes(want)


def test_empty_table(spark):
    got = trie.nodes(trie.rebuilt(spark.createDataFrame([], TURNS)))
    assert got.columns == COLUMNS and got.collect() == []


def test_forest_of_one_partition_in_any_order_of_merges():
    """Every node on neither boundary path has its final values."""
    rng = random.Random(5)
    keys = sorted({bytes(b for _ in range(rng.randint(1, 6)) for b in [rng.choice(b"abc")] * trie.WIDTH) for _ in range(80)})
    forest = trie.Forest()
    for i, key in enumerate(keys):
        size = len(key) // trie.WIDTH
        forest.add(key, [1] * size, (i + 1, i, None, 0, 0, 0))
    got = forest.solve()
    want = {}
    for i, key in enumerate(keys):
        for d in range(1, len(key) // trie.WIDTH + 1):
            node = want.setdefault(key[:d * trie.WIDTH], [0, i])
            node[0] += i + 1
    assert forest.total == len(want)
    assert sorted(got["n"][:-1]) == sorted(n for n, _ in want.values())
    assert sorted(got["least"][:-1]) == sorted(i for _, i in want.values())
