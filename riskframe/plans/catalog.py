"""Queries on the supplied tables, each with the SQL that must give the same rows.

A query reads whole tables. Decimals are rounded on both sides, since sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL where there is one."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def r(c: Column | str, digits: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    rounded = F.round(F.col(c) if name else c, digits)
    return rounded.alias(name) if name else rounded


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Shared parts of the SQL side ----------------------------------------------------------

LOG = """log AS (SELECT l_orderkey AS plan_id, l_shipdate AS cancel_date, l_quantity AS quantity
 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 42)"""

LABELLED = LOG + """, labelled AS (SELECT o.*, o_orderkey IN (SELECT plan_id FROM log) AS was_canceled FROM orders o)"""

WITH_LINES = """wide AS (SELECT o.*, first_ship, part, supp, lines, quantity, discount, tax FROM orders o LEFT JOIN (
 SELECT l_orderkey, min(l_shipdate) AS first_ship, min(l_partkey) AS part, min(l_suppkey) AS supp,
 count(*) AS lines, sum(l_quantity) AS quantity, max(l_discount) AS discount, max(l_tax) AS tax
 FROM lineitem GROUP BY l_orderkey) x ON l_orderkey = o_orderkey)"""

SCORED = LABELLED + """, scored AS (SELECT o_orderkey AS key, was_canceled::INT AS label, o_orderpriority AS grp,
 (floor((o_totalprice % 1000.0::DOUBLE) * 10) / 10000.0::DOUBLE) * 0.5::DOUBLE + coalesce(largest, 0.0::DOUBLE) / 101.0::DOUBLE AS score
 FROM labelled LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS largest FROM lineitem GROUP BY l_orderkey) x
 ON l_orderkey = o_orderkey)"""

CURVE = SCORED + """, counts AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
 FROM scored GROUP BY score),
 curve AS (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER ())::BIGINT AS p,
 (sum(neg) OVER ())::BIGINT AS n FROM counts WINDOW w AS (ORDER BY score DESC))"""

GRID = """grid AS (SELECT i::INT AS step, 0.05::DOUBLE + i * 0.010000000000000002::DOUBLE AS threshold FROM range(91) t(i))"""

SWEEP = SCORED + ", " + GRID + """, counted AS (SELECT step, threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
 count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1) AS p FROM grid, scored GROUP BY step, threshold),
 sweep AS (SELECT step, threshold, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(p, 0), 0) AS recall,
 coalesce((2 * tp)::DOUBLE / nullif(tp + fp + p, 0), 0) AS f1_score FROM counted)"""

PR = CURVE + """, pr AS (SELECT score AS threshold, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall FROM curve)"""


def matrix_sql(threshold: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""m AS (SELECT {group}count(*) FILTER (label = 0 AND score < {threshold}) AS tn, count(*) FILTER (label = 0 AND score >= {threshold}) AS fp,
 count(*) FILTER (label = 1 AND score < {threshold}) AS fn, count(*) FILTER (label = 1 AND score >= {threshold}) AS tp FROM scored
 {"GROUP BY " + by if by else ""})"""


METRIC_COLUMNS = """round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
 round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score"""

REPORT_LINES = """t AS (SELECT *, (tp + fp + fn + tn) AS total, tn::DOUBLE / nullif(tn + fn, 0) AS p0, tn::DOUBLE / nullif(tn + fp, 0) AS r0,
 (2 * tn)::DOUBLE / nullif(2 * tn + fn + fp, 0) AS f0, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p1, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r1,
 coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM m)"""

ELAPSED = "floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0)::BIGINT"


def describe_sql(source: str, columns: list[str], by: str = "") -> str:
    """Long-form description; ``source`` is a table or a parenthesised query."""
    group = f"{by}, " if by else ""
    parts = []
    for c in columns:
        stats = {
            "count": f"count({c})::DOUBLE", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})::DOUBLE",
            "25%": f"quantile_cont({c}, 0.25)::DOUBLE", "50%": f"quantile_cont({c}, 0.5)::DOUBLE",
            "75%": f"quantile_cont({c}, 0.75)::DOUBLE", "max": f"max({c})::DOUBLE",
        }
        for stat, expr in stats.items():
            parts.append(
                f"SELECT {group}'{c}' AS \"column\", '{stat}' AS stat, round({expr}, 4) AS value FROM {source}"
                + (f" GROUP BY {by}" if by else "")
            )
    return " UNION ALL ".join(parts)
