"""Every named query runs, and equals its SQL twin where it has one."""

import pytest
from compare import differences, duck

from __spark_entry__ import entry, oracle_sql, queries


@pytest.mark.parametrize("name", sorted(set(oracle_sql())))
def test_equals_twin(spark, sf_dir, name):
    assert differences(queries()[name](spark, sf_dir), duck(sf_dir).execute(oracle_sql()[name])) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 5


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
