"""Language of a text from piece probabilities per language, summed over all segmentations.

The pieces are those of a fixed public vocabulary. A word (a run of letters, lower-cased, with the
vocabulary's word mark in front) can be cut into pieces in many ways; its probability in a language is
the sum over all of them, found with the forward algorithm. A text's likelihood is the product over
its words. Piece probabilities come from expectation maximisation over the same lattices.

Training uses a sample of at most about ``docs_per_language`` labelled documents of each language, chosen
by a hash of the key; everything scored is whole. Every lang value is learned; each is trained in a task
of its own, and the driver gets one probability per piece and language.

Null text, or text without a letter: language "und", score 0. A null key counts as the empty key.
Ties go to the first language by name. Repeated rows get equal results. Without training rows every
text is "und". Very long texts and words: a word of more than ``MAX_WORD`` letters is summed letter by letter
over the last ``MAX_PIECE`` sums, so its score too covers all segmentations; only in training are such
words counted in parts. Other columns of docs stay; the two new ones must not be among them (see ``prefix``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.session import settle

from .common import Batches, in_slices, keep_only
from .tokens import grouped

UNKNOWN = "und"
MARK = "▁"
MAX_WORD = 40
MAX_PIECE = 16
#: Languages whose sums are held at a time.
LANGUAGES_AT_ONCE = 16
DOCS_PER_LANGUAGE = 400
ROUNDS = 3
#: Pseudo-count of every piece, and the probability of a character that is no piece.
PSEUDO, FLOOR = 0.01, 1e-8
#: Words whose scores a Python worker keeps, and characters it takes apart at a time.
CACHE_WORDS = 250_000
CHARS = 1_000_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _LETTERS.findall(text.lower()) if text else []
    if found and not "".join(found).isalpha():  # the expression takes superscripts and the like for letters
        blanked = ("".join(c if c.isalpha() else " " for c in w) for w in found)
        found = [part for w in blanked for part in w.split()]
    return found


def in_parts(words: list[str]) -> list[str]:
    """Words with the long ones cut."""
    return [w[i:i + MAX_WORD] for w in words for i in range(0, len(w), MAX_WORD)]


def vocabulary_pieces(path: str) -> list[str]:
    """Pieces of letters only, as written in the vocabulary file (sentencepiece model)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    all_pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p.lower() for p in all_pieces if (p.lstrip(MARK) or "a").isalpha() and p.count(MARK) <= 1 and len(p) <= MAX_PIECE})


class Lattice:
    """Words of equal length with, for each span, the index of the piece it is (-1: none; -2: an
    unknown single character)."""

    def __init__(self, words: list[str], index: dict[str, int]):
        self.n, get = len(words[0]), index.get
        self.spans: list[tuple[int, int, np.ndarray]] = []
        for end in range(1, self.n + 1):
            for start in range(max(0, end - MAX_PIECE), end):
                missing = -2 if end - start == 1 else -1
                ids = np.fromiter(map(get, [w[start:end] for w in words], repeat(missing)), np.int64, len(words))
                if missing == -2 or (ids >= 0).any():
                    self.spans.append((start, end, ids))

    def forward(self, table: np.ndarray) -> np.ndarray:
        """[position, word, language]; ``table`` has a row per piece, then one of FLOOR and one of 0."""
        sums = np.zeros((self.n + 1, len(self.spans[0][2]), table.shape[1]))
        sums[0] = 1.0
        for start, end, ids in self.spans:
            sums[end] += sums[start] * table[ids]
        return sums

    def expected(self, table: np.ndarray, weights: np.ndarray, into: np.ndarray) -> None:
        """Add the expected piece counts of the words to ``into`` (one language)."""
        sums = self.forward(table)[:, :, 0]
        back = np.zeros_like(sums)
        back[self.n] = 1.0
        for start, end, ids in reversed(self.spans):
            back[start] += back[end] * table[ids, 0]
        scale = weights / sums[self.n]
        for start, end, ids in self.spans:
            np.add.at(into, ids, sums[start] * table[ids, 0] * back[end] * scale)


def by_length(words: list[str]) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    return iter(groups.values())


def with_tail(probabilities: np.ndarray) -> np.ndarray:
    tail = np.vstack([np.full(probabilities.shape[1], FLOOR), np.zeros(probabilities.shape[1])])
    return np.vstack([probabilities, tail])


class Model:
    """Languages, pieces and their probabilities [piece, language]."""

    def __init__(self, languages: list[str], pieces: list[str], probabilities: np.ndarray):
        self.languages, self.pieces = languages, pieces
        self.index = {p: i for i, p in enumerate(pieces)}
        self.table = with_tail(probabilities)
        self.seen: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))
        starts = range(0, len(languages), LANGUAGES_AT_ONCE)
        self.parts = [self] if len(starts) <= 1 else [
            Model(languages[i:i + LANGUAGES_AT_ONCE], pieces, probabilities[:, i:i + LANGUAGES_AT_ONCE]) for i in starts]
        self.sharers = 1
        for part in self.parts:
            part.sharers = len(self.parts)

    def __reduce__(self):
        return Model, (self.languages, self.pieces, self.table[:-2])

    def long_score(self, word: str) -> np.ndarray:
        """Log probability of one word of any length: only the last sums are kept, scaled per language."""
        word, get = MARK + word, self.index.get
        sums = np.ones((1, len(self.languages)))  # of the last positions, the newest in front
        logs = np.zeros(len(self.languages))
        for end in range(1, len(word) + 1):
            found = [get(word[end - k:end], -1) for k in range(1, len(sums) + 1)]
            back = [k for k, i in enumerate(found) if i >= 0 or k == 0]
            ids = [found[k] if found[k] >= 0 else -2 for k in back]
            new = (sums[back] * self.table[ids]).sum(axis=0)
            sums = np.vstack([new, sums[:MAX_PIECE - 1]])
            if end % 8 == 0:
                top = sums.max(axis=0)
                sums /= top
                logs += np.log(top)
        return logs + np.log(sums[0])

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        at = {w: i for i, w in enumerate(words)}
        for group in by_length(words):
            rows = [at[w] for w in group]
            if len(group[0]) > MAX_WORD:
                out[rows] = [self.long_score(w) for w in group]
                continue
            sums = Lattice([MARK + w for w in group], self.index).forward(self.table)[-1]
            out[rows] = np.log(np.maximum(sums, 1e-300))
            for i in np.flatnonzero((sums < 1e-290).any(axis=1)):  # near the smallest number
                out[rows[i]] = self.long_score(group[i])
        return out

    def text_scores(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """Log likelihood of each text, given as words; None without words. Long words are not kept."""
        met = set().union(*texts)
        new = [w for w in met - self.seen.keys() if len(w) <= MAX_WORD]
        if len(self.seen) + len(new) > CACHE_WORDS // self.sharers:
            self.forget()
            new = [w for w in met if len(w) <= MAX_WORD]
        first = len(self.seen)
        self.seen.update(zip(new, range(first, first + len(new))))
        if len(self.scores) < first + len(new):
            grown = np.zeros((max(2 * len(self.scores), first + len(new)), len(self.languages)))
            grown[:first] = self.scores[:first]
            self.scores = grown
        self.scores[first:first + len(new)] = self.word_scores(new)
        get, found = self.seen.get, []
        for ws in texts:
            ids = np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws))
            if ws and ids.min() < 0:
                total = self.scores[ids[ids >= 0]].sum(axis=0)
                found.append(sum((self.long_score(ws[i]) for i in np.flatnonzero(ids < 0)), total))
            else:
                found.append(self.scores[ids].sum(axis=0) if ws else None)
        return found

    def forget(self) -> None:
        for part in self.parts:
            part.seen, part.scores = {}, np.zeros((0, len(part.languages)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Best language and its share of the likelihood, a few languages at a time."""
        found = []
        for a, b in grouped([t or "" for t in texts], CHARS):
            words = [words_of(t) for t in texts[a:b]]
            best = [(UNKNOWN, -math.inf, 0.0)] * len(words)  # language, its likelihood, sum of all relative to it
            for part in self.parts:
                for i, likelihood in enumerate(part.text_scores(words) if part.languages else []):
                    if likelihood is None:
                        continue
                    k = int(likelihood.argmax())
                    name, top, total = best[i]
                    here, others = float(likelihood[k]), float(np.exp(likelihood - likelihood[k]).sum())
                    best[i] = (part.languages[k], here, others + total * math.exp(top - here)) if here > top else (
                        name, top, total + others * math.exp(here - top))
            found += [(name, 1 / total if total else 0.0) for name, _, total in best]
        return found


def train_one(counts: dict[str, int], index: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of a language from word -> occurrences."""
    lattices = [(Lattice([MARK + w for w in group], index), np.array([counts[w] for w in group], dtype=float))
                for group in by_length(sorted(counts))]
    p = np.full(len(index), 1 / len(index))
    for _ in range(rounds):
        seen = np.zeros(len(index) + 2)
        for lattice, weights in lattices:
            lattice.expected(with_tail(p[:, None]), weights, seen)
        p = (seen[:-2] + PSEUDO) / (seen[:-2] + PSEUDO).sum()
    return p


def model_of(columns: dict[str, np.ndarray], pieces: list[str]) -> Model:
    languages = sorted(columns)
    return Model(languages, pieces, np.array([columns[k] for k in languages]).T if languages else np.zeros((len(pieces), 0)))


def train(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """counts: language -> word -> occurrences."""
    index = {p: i for i, p in enumerate(pieces)}
    return model_of({language: train_one(words, index, rounds) for language, words in counts.items()}, pieces)


def held_out(key: Column | str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the key as text leaves 2 when divided by 4."""
    text = F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def sample_counts(docs: DataFrame, docs_per_language: int) -> DataFrame:
    """lang, word, count over the training sample: docs has doc_id, text, lang."""
    sizes, small = settle(docs.groupBy("lang").count())
    # a language keeps all documents or, of many, those whose hash lies below a bound
    share = F.least(F.lit(1.0), F.lit(float(docs_per_language)) / F.col("count"))
    bounds = sizes.select(F.col("lang").alias("of"), F.floor(share * 1_000_000).alias("bound"))
    chosen = docs.join(F.broadcast(bounds) if small else bounds, F.col("lang") == F.col("of")).filter(
        F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < F.col("bound"))

    def run(batches: Batches) -> Batches:
        for batch in in_slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = in_parts(words_of(text))
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words)], names=["lang", "word"])

    return chosen.select("lang", "text").mapInArrow(run, "lang string, word string").groupBy("lang", "word").count()


def fit(docs: DataFrame, vocabulary: str, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from the rows of doc_id, text, lang that are not held out and have a language."""
    known = docs.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")).filter(
        ~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    pieces = vocabulary_pieces(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary

    def learn(words: pa.Table) -> pa.Table:
        index = {p: i for i, p in enumerate(shared.value)}
        p = train_one(dict(zip(words.column("word").to_pylist(), words.column("count").to_pylist())), index)
        return pa.table({"lang": pa.array([words.column("lang")[0].as_py()], pa.string()), "p": pa.array([p.tobytes()], pa.binary())})

    learned = sample_counts(known, docs_per_language).groupBy("lang").applyInArrow(learn, "lang string, p binary").toArrow()
    columns = zip(learned.column("lang").to_pylist(), learned.column("p").to_pylist())
    return model_of({lang: np.frombuffer(p) for lang, p in columns}, pieces)


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """Adds lang_pred and score, names with ``prefix`` in front; the columns of docs stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages
    names = [f"{prefix}lang_pred", f"{prefix}score"]

    def run(batches: Batches) -> Batches:
        fitted = shared.value
        keep_only(f"language {id(fitted)}", fitted.forget)
        for batch in in_slices(batches):
            found = fitted.predict(batch.column("text").to_pylist())
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {names[0]} string, {names[1]} double")


def accuracy(predicted: DataFrame) -> float:
    row = predicted.filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    return row[0] if row[0] is not None else math.nan
