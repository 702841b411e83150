"""Half-open binning, the threshold grid and other numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.clean import _col
from riskframe.functions.fixed import (
    DISTANCE_EDGES, F1_EPSILON, GRID_POINTS, GRID_START, GRID_STEP, MISSING,
)


def bin_label(
    c: Column | str, edges: Sequence[float], labels: Sequence[str], missing: str | None = MISSING
) -> Column:
    """Label of the [a, b) interval a value falls in; ``missing`` outside all of them."""
    if len(labels) != len(edges) - 1:
        raise ValueError(f"{len(edges)} edges need {len(edges) - 1} labels, got {len(labels)}")
    col = _col(c).cast("double")
    # edges ascend, so one comparison per label is enough; NaN is above every edge
    expr = F.when(col < float(edges[0]), F.lit(missing))
    for high, label in zip(edges[1:], labels):
        expr = expr.when(col < float(high), F.lit(label))
    return expr.otherwise(F.lit(missing))


def range_labels(edges: Sequence[float], unit: str) -> list[str]:
    """"0-5 km" ... "500+ km" for edges that end in infinity."""
    inner = [f"{a}-{b} {unit}" for a, b in zip(edges, edges[1:-1])]
    return [*inner, f"{edges[-2]}+ {unit}"]


DISTANCE_LABELS = range_labels(DISTANCE_EDGES, "km")


def ratio(numerator: Column | str, denominator: Column | str, default: float = 0.0) -> Column:
    """Quotient of two numbers, ``default`` where the denominator is zero or missing."""
    return F.coalesce(F.try_divide(_col(numerator).cast("double"), _col(denominator)), F.lit(default))


def f1(precision: Column, recall: Column, epsilon: float = 0.0) -> Column:
    """Harmonic mean; with ``epsilon`` the denominator never vanishes."""
    return ratio(2 * precision * recall, precision + recall + F.lit(epsilon))


def curve_f1(precision: Column, recall: Column) -> Column:
    return f1(precision, recall, F1_EPSILON)


def threshold_grid() -> list[float]:
    return [GRID_START + i * GRID_STEP for i in range(GRID_POINTS)]


def number_array(values: Sequence[float]) -> Column:
    """A constant array of doubles, parsed at once instead of built element by element."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def predicted(score: Column | str, threshold: Column | float) -> Column:
    """1 where the score reaches the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_col(score) >= limit).cast("int")


def round_half_even(c: Column | str, digits: int) -> Column:
    return F.bround(_col(c), digits)


def with_position(
    df: DataFrame, targets: dict[str, tuple[Column | str, Column]], points: int
) -> DataFrame:
    """For each ``{new column: (value, sorted array)}`` add how many array entries are <= value.

    A binary search spelled as a chain of projections: about log2(points) comparisons per
    value, all inside generated code, and a pure function of the value. Null values give null.
    """
    step = 1
    while step * 2 <= points:
        step *= 2
    values = {name: _col(value) for name, (value, _) in targets.items()}
    cuts = {name: f"__cuts_{name}" for name in targets}
    df = df.withColumns({cuts[name]: array for name, (_, array) in targets.items()})
    df = df.withColumns({name: F.lit(0) for name in targets})
    while step:
        moved = {}
        for name in targets:
            position = F.col(name)
            reached = values[name] >= F.get(F.col(cuts[name]), position + (step - 1))
            moved[name] = F.when(reached, position + step).otherwise(position)
        df = df.withColumns(moved)
        step //= 2
    df = df.withColumns({name: F.when(values[name].isNotNull(), F.col(name)) for name in targets})
    return df.drop(*cuts.values())
