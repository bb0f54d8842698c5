"""Every registered query of the engine against its oracle, and the driver's contract."""

import pytest

from lodespark.plans import registry

ALL = registry()


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_matches_oracle(name, same):
    same(*ALL[name])


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if not sql])
def test_runs_without_oracle(name, spark, sf):
    assert ALL[name][0](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
