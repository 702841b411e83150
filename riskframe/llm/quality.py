"""Quality rules with risk-controlled cutoffs.

Each document gets the counts of ``measures``. A rule rejects a document whose value is above the
rule's cutoff. Cutoffs come from labelled rows, per stratum: a fixed grid is tested from the highest
cutoff down, and the last one is taken for which an exact binomial test shows that at most ``alpha /
number of rules`` of the good documents lie above it; the first failure ends the sequence. Each test
has level ``delta`` divided by the number of strata and rules (Bonferroni); a fixed sequence that stops
at its first failure needs no division by its length. So with probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents. A
stratum with too few labels gets no cutoff and keeps all.

All labelled rows count. Cutoffs are found in tasks, a stratum in one of them, from one count per rule and
grid cell; the driver learns the number of strata only.

Null or empty text: no words, so the base rule fails it. Very long texts are counted whole, in memory in
proportion to the text. Null stratum: a stratum of its own. Several labels for one document: the lowest counts.
Null labels are not used. Repeated rows are judged alike. Empty tables give no rows. Other columns stay outside.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.session import settle

from .common import per_row, staged

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")


def repeated_words(words: list[bytes]) -> int:
    """Positions covered by windows of three words that occur at least twice."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 1_000_000:  # so that the product below cannot overflow
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(known) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(words), dtype=bool)
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    for step in range(3):
        twice[starts + step] = True
    return int(twice.sum())


def counts(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines = Counter(ln for ln in raw.split(b"\n") if ln.strip())
    n_lines = lines.total()
    blanks = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    return (
        len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), n_lines - len(lines),
        repeated_words(words), n_lines, raw.count(b"!") + raw.count(b"?"), sum(w.isupper() for w in words),
    )


def measures(docs: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stratum and the counts of every document."""
    fields = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((c, pa.int64()) for c in COUNTS)])
    run = per_row(lambda key, part, text: (key, part, *counts(text)), ["doc_id", "stratum", "text"], fields)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def _per(c: str, of: str) -> Column:
    return F.coalesce(F.col(c) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))


def rules() -> dict[str, tuple[Column, list[float]]]:
    """Rule name -> (value, grid of cutoffs). The grids are fixed, so the labels choose only among them."""
    steps = lambda top: [round(top * i / 20, 4) for i in range(1, 21)]
    return {
        "symbols_per_word": (_per("n_symbols", "n_words"), steps(2.0)),
        "repeated_share": (_per("n_repeat_words", "n_words"), steps(1.0)),
        "duplicate_line_share": (_per("n_dup_lines", "n_lines"), steps(1.0)),
        "marks_per_word": (_per("n_marks", "n_words"), steps(2.0)),
        "upper_share": (_per("n_upper", "n_words"), steps(1.0)),
        "mean_word_length": (_per("word_chars", "n_words"), [float(x) for x in range(6, 26)]),
    }


def _beyond_stirling(n: int) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - 1 / 1260 / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    return x * math.log1p((x - mean) / mean) - (x - mean)


def binomial_pmf(k: int, n: int, p: float) -> float:
    """P(X = k); written as deviances, so that it stays accurate for large n."""
    if k == 0 or k == n:
        return math.exp(n * (math.log(p) if k else math.log1p(-p)))
    log = (_beyond_stirling(n) - _beyond_stirling(k) - _beyond_stirling(n - k)
           - _deviance(k, n * p) - _deviance(n - k, n * (1 - p)))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exact up to rounding. The shorter tail is summed away from the
    mean until its terms no longer count: about sqrt(n) steps and no memory."""
    if k >= n:
        return 1.0
    low = k < n * p
    i = k if low else k + 1
    term = total = binomial_pmf(i, n, p)
    while term > total * 1e-17:
        if low:
            term *= i / (n - i + 1) * (1 - p) / p
            i -= 1
        else:
            term *= (n - i) / (i + 1) * p / (1 - p)
            i += 1
        total += term
    return min(1.0, total) if low else max(0.0, 1 - total)


def choose_cutoffs(above: dict[tuple, int], good: dict, grids: dict[str, list[float]], alpha: float, delta: float,
                   strata: int | None = None) -> dict:
    """above: (stratum, rule, grid index) -> good documents above that cutoff; good: per stratum.
    ``strata`` is their number where these are only some of them."""
    level = delta / (max(1, strata or len(good)) * len(grids))
    share = alpha / len(grids)

    def lowest(stratum: object, rule: str, grid: list[float], n: int) -> float:
        found = math.inf
        for i in reversed(range(len(grid))):
            if binomial_cdf(above.get((stratum, rule, i), 0), n, share) > level:
                break
            found = grid[i]
        return found

    return {s: {rule: lowest(s, rule, grid, n) for rule, grid in grids.items()} for s, n in good.items()}


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Cutoffs, one row per stratum, from labels (doc_id, quality); quality 1 is good."""
    known = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"))
    good = measured.join(known, F.col("doc_id") == F.col("label_id")).filter((F.col("quality") == 1) & (F.col("n_words") >= MIN_WORDS))
    cells = F.array(*(
        F.struct(F.lit(name).alias("rule"), sum(((value > c).cast("int") for c in grid), F.lit(0)).alias("cell"))
        for name, (value, grid) in rules().items()
    ))
    held = staged(good.select("stratum", F.explode(cells).alias("c")).groupBy("stratum", "c.rule", "c.cell").agg(F.count("*").alias("n")))
    strata = held.select("stratum").distinct().count()
    grids = {name: grid for name, (_, grid) in rules().items()}

    def choose(counted: pa.Table) -> pa.Table:
        above: Counter = Counter()
        total = 0
        for rule, cell, n in zip(*(counted.column(c).to_pylist() for c in ("rule", "cell", "n"))):
            total += n if rule == "symbols_per_word" else 0
            for i in range(cell):  # a document of cell k lies above the first k cutoffs
                above[("", rule, i)] += n
        found = choose_cutoffs(above, {"": total}, grids, alpha, delta, strata)[""]
        return pa.table({"cut_stratum": pa.array([counted.column("stratum")[0].as_py()], pa.string()),
                         **{f"cut_{name}": pa.array([float(found[name])], pa.float64()) for name in grids}})

    fields = "cut_stratum string, " + ", ".join(f"cut_{name} double" for name in grids)
    return held.groupBy("stratum").applyInArrow(choose, fields)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed, rejected_by (names of the rules that reject) and kept."""
    limits, small = settle(cutoffs)
    joined = measured.join(F.broadcast(limits) if small else limits, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    hits = F.array_compact(F.array(*(F.when(value > F.col(f"cut_{n}"), F.lit(n)) for n, (value, _) in rules().items())))
    return joined.select(*measured.columns, base_failed().alias("base_failed"), hits.alias("rejected_by")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def score(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Measures, calibration and verdict. The counts are written once and used for both."""
    measured = staged(measures(docs, stratum))
    return judge(measured, calibrate(measured, labels, alpha, delta))
