"""Every registered query of the library: its rows against the second engine's, or that it runs."""

import pytest

from tessera import catalog

from .compare import same_rows
from .conftest import DATA

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.001"), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_with_a_stable_schema(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["nap_conflict_summary", "source_variants"])
def test_distinct_counts_write_each_row_once(spark, name):
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "collect_set" in plan
