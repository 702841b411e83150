"""Spelling variants: words of a vocabulary that are one inserted, deleted or replaced code point apart.

Method: compose the minimal acceptor of the vocabulary with a one-edit transducer and the acceptor
again. A path of the composition reads a common beginning in one state of the acceptor, takes one edit
into a pair of states, and then needs a common ending of both; since the acceptor is minimal, the
endings of a pair of states are found once for all beginnings that lead there.

The composition is cut into partitions by the state it starts in. Take a class of words of n and n + 1
code points: an edit either lies behind the first half of n or before the last one, so the two words share
the one or the other. Each word is sent to both partitions, for n its own length and one less. A
partition of more than ``MOST_WORDS`` words is not held: its words pass on to the next round, where
each half that may hold the edit is halved again; in the end a single position is left, and as many words
as there are letters. The edit position decides to which partition a pair belongs, so each is found once.

What is shuffled is the vocabulary, four times; no pair of words is ever a row unless `pairs` is asked for.

Defined cases: null or empty texts have no words; a null doc_id counts as an empty one; repeated rows count
again. Very long texts are cut between words as they are read, and very long words are words. Ties of
the best near word go to the smaller one in code-point order. No document or no word: an empty result.
Other columns stay outside.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Batches, keep_only, keyed_texts, staged

LETTERS = "A-Za-zÀ-ÿ"
#: A document's run loses a letter where this divides its checksum.
THINNED = 31
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent.
TIMES = 10
#: Words of a partition that a task holds at a time.
MOST_WORDS = 20_000
#: Characters of a text taken apart at a time, and words a task counts before it hands them on.
SLICE, HELD = 1 << 20, 200_000

COUNTED = "word string, n long"
CELL = "cls int, l int, r int, left string, right string, rest string, n long"
FOUND = f"{CELL}, near long, best string, best_n long, open boolean"
PAIRS = f"{CELL}, other string, other_n long, open boolean"


# --- vocabulary ------------------------------------------------------------------------

def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` characters that end where no run of letters goes on."""
    at, outside = 0, re.compile(f"[^{LETTERS}]")
    while len(text) - at > size:
        cut = outside.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def words_of(doc_id: str, text: str, least: int = LEAST_LETTERS) -> Counter:
    """Counts of a document's words; ``doc_id`` is the decimal key."""
    runs: Counter = Counter()
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")
    for part in slices(text):
        # lower() of bytes changes A to Z only
        runs.update(pattern.findall(part.encode().lower().decode()))
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % THINNED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def _count(least: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        keep_only("spelling")
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                key = doc_id.as_py()
                held.update(words_of("" if key is None else str(key), text.as_py(), least))
                if len(held) > HELD:
                    yield hand_on()
        if held:
            yield hand_on()
    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts. A task counts before anything is shuffled."""
    parts = keyed_texts(docs).mapInArrow(_count(least_letters), COUNTED)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- acceptor and composition ------------------------------------------------------------

class Acceptor:
    """Minimal acyclic acceptor of a sorted list of distinct words. A state is a number; ``final[q]`` tells
    whether a word ends there, ``arcs[q]`` gives the next state by letter."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]  # open states along the last word
        last = ""
        for word in words:
            common = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                common += 1
            self._close(path, last, common)
            path.extend((False, {}) for _ in range(len(word) - common))
            path[-1] = (True, path[-1][1])
            last = word
        self._close(path, last, 0)
        self.start = self._register(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        while len(path) - 1 > depth:
            state = self._register(*path.pop())
            path[-1][1][word[len(path) - 1]] = state

    def _register(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.final)
            self.final.append(final)
            self.arcs.append(arcs)
        return state


class OneEdit:
    """The acceptor composed with one edit and itself again: pairs of accepted words one edit apart, each
    once, the edit placed as far behind as it can be."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self._endings: dict[tuple[int, int], list[str]] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}

    def endings(self, p: int, q: int) -> list[str]:
        """Texts that lead to an end from both states."""
        if p > q:
            p, q = q, p
        found = self._endings.get((p, q))
        if found is None:
            a = self.a
            found = [""] if a.final[p] and a.final[q] else []
            others = a.arcs[q]
            for letter, to in a.arcs[p].items():
                if letter in others:
                    found.extend(letter + s for s in self.endings(to, others[letter]))
            self._endings[p, q] = found
        return found

    def edits(self, q: int) -> list[tuple[str, str]]:
        """Pairs of endings from state q whose first letters differ by the edit."""
        found = self._edits.get(q)
        if found is None:
            found = []
            arcs = list(self.a.arcs[q].items())
            for i, (x, p) in enumerate(arcs):
                # one word has x in addition, the other goes on from q itself, not with x
                found.extend((s, x + s) for s in self.endings(q, p) if not s.startswith(x))
                for y, r in arcs[:i]:  # one word has x where the other has y
                    found.extend((y + s, x + s) for s in self.endings(r, p))
            self._edits[q] = found
        return found

    def pairs(self) -> Iterator[tuple[str, str, int]]:
        """Two words and the position of their edit."""
        todo = [("", self.a.start)]
        while todo:
            begun, q = todo.pop()
            for u, v in self.edits(q):
                yield begun + u, begun + v, len(begun)
            todo.extend((begun + letter, to) for letter, to in self.a.arcs[q].items())


def near_pairs(words: list[str], size: int, open_end: bool) -> Iterator[tuple[str, str]]:
    """Pairs of a partition: one of ``size`` letters and one of as many or one more, one edit apart. The edit
    may lie behind the last letter only where ``open_end``, that is, where nothing shared follows."""
    for u, v, at in OneEdit(Acceptor(words)).pairs():
        if (len(u) == size or len(v) == size) and (open_end or at < size):
            yield u, v


# --- partitions ----------------------------------------------------------------------------

def _cell(l: Column, r: Column) -> Column:
    """The word's place in the partition that shares its first l and last r letters."""
    word = F.concat("left", "rest", "right")
    return F.struct(
        F.col("cls"), l.cast("int").alias("l"), r.cast("int").alias("r"), F.substring(word, F.lit(1), l).alias("left"),
        F.substring(word, F.length(word) - r + 1, r).alias("right"),
        F.substring(word, l + 1, F.length(word) - l - r).alias("rest"), F.col("n"))


def halved(cells: DataFrame) -> DataFrame:
    """Each row in the two partitions that share one more half of what was not shared."""
    l, r, size = F.col("l"), F.col("r"), F.col("cls") - F.col("l") - F.col("r")
    front = F.ceil(size / 2).cast("int")
    both = F.array(_cell(l + front, r), _cell(l, r + size - front))
    whole = F.array(_cell(l, r))  # of one letter or none there is no half
    return cells.select(F.explode(F.when(size > 1, both).otherwise(whole)).alias("cell")).select("cell.*")


def _search(emit: str, most: int) -> Callable[[Batches], Batches]:
    """Rows sorted by partition. ``open`` rows are those of a partition that is too large to hold."""
    schema = pa.schema([("cls", pa.int32()), ("l", pa.int32()), ("r", pa.int32()), ("left", pa.string()), ("right", pa.string()),
                        ("rest", pa.string()), ("n", pa.int64())])
    more = {"near": [("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())],
            "pairs": [("other", pa.string()), ("other_n", pa.int64())]}[emit]
    schema = pa.schema([*schema, *more, ("open", pa.bool_())])

    def one(key: tuple, rows: dict[str, int]) -> Iterator[tuple]:
        cls, l, r, left, right = key
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * max(map(len, rows)) + 1_000))
        found = near_pairs(list(rows), cls - l - r, r == 0)
        if emit == "pairs":
            for u, v in found:
                yield (*key, u, rows[u], left + v + right, rows[v], False)
                yield (*key, v, rows[v], left + u + right, rows[u], False)
            return
        best: dict[str, list] = {}  # near words, largest n, its word
        for pair in found:
            for u, v in (pair, pair[::-1]):
                n, mine = rows[v], best.get(u)
                if mine is None:
                    best[u] = [1, n, v]
                else:
                    mine[0] += 1
                    if n > mine[1] or n == mine[1] and v < mine[2]:
                        mine[1:] = n, v
        for u, (near, n, v) in best.items():
            yield (*key, u, rows[u], near, left + v + right, n, False)

    def run(batches: Batches) -> Batches:
        keep_only("spelling")
        key, rows, large = None, {}, False
        out: list[tuple] = []
        still_open = tuple([None] * len(more) + [True])

        def end() -> None:
            if not large and len(rows) > 1:
                out.extend(one(key, rows))

        def batch_of(rows_out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_out), schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for *at, rest, n in zip(*columns):
                at = tuple(at)
                if at != key:
                    end()
                    key, rows, large = at, {}, False
                if large:
                    out.append((*key, rest, n, *still_open))
                else:
                    rows[rest] = n
                    if len(rows) > most and key[0] - key[1] - key[2] > 1:
                        out.extend((*key, w, k, *still_open) for w, k in rows.items())
                        rows, large = {}, True
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
        end()
        for i in range(0, len(out), 20_000):
            yield batch_of(out[i:i + 20_000])
    return run


def _rounds(words: DataFrame, emit: str, most: int) -> DataFrame:
    """All rounds: search, and halve what was too large, until nothing is."""
    n = F.length("word")
    classes = F.array_compact(F.array(n, F.when(n > 1, n - 1)))
    cells = words.select(
        F.explode(classes).alias("cls"), F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit("").alias("left"), F.lit("").alias("right"),
        F.col("word").alias("rest"), F.col("n"))
    done = None
    while True:
        key = ["cls", "l", "r", "left", "right"]
        dealt = halved(cells).repartition(*key).sortWithinPartitions(*key, "rest")
        found = staged(dealt.mapInArrow(_search(emit, most), FOUND if emit == "near" else PAIRS))
        part = found.filter("NOT open").withColumn("word", F.concat("left", "rest", "right"))
        done = part if done is None else done.unionByName(part)
        cells = found.filter("open").select(*[c.split()[0] for c in CELL.split(", ")])
        if cells.isEmpty():
            return done


def pairs(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, n -> word, other, n, other_n: every ordered pair of near words."""
    return _rounds(words, "pairs", most).select("word", "other", "n", "other_n")


def near(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, n -> word, n_near, best, best_n of the words that have a near one."""
    found = _rounds(words, "near", most)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: forms followed to the last. Counts rise tenfold with every step, so a
    chain is short; each round doubles what is followed."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        new = staged(now.join(on, now["root"] == on["via"], "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = staged(vocabulary(docs, least_letters, least_count))
    is_form = F.col("best_n") >= times * F.col("n")
    with_form = staged(words.join(near(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(with_form.filter("form IS NOT NULL"))
    return with_form.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
