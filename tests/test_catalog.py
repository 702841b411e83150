"""The query catalogue against its SQL, and the shape of the entry points."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import connect, differences  # noqa: E402

CHECKED = sorted(entry.oracle_sql())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf):
    df = entry.entry(spark)
    assert df.columns == ["o_orderpriority", "rate", "n"] and df.count() == 5


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toArrow()
    want = connect(sf).execute(entry.oracle_sql()[name]).to_arrow_table()
    assert not differences(got, want)
