"""Every query with SQL agrees with it; every other runs and keeps its schema."""

import pytest

from lodewright.plans.oracle import ORACLE
from lodewright.plans.queries import QUERIES
from tests.util import same_rows, tables


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, tiny, name):
    same_rows(QUERIES[name](spark, tiny), ORACLE[name], tables(tiny))


def test_only_the_vocabulary_metrics_have_no_sql():
    assert set(QUERIES) - set(ORACLE) == {"vocabulary_metrics"}


def test_vocabulary_metrics(spark, tiny):
    """Fixed texts and a fixed vocabulary, so fixed figures."""
    got = QUERIES["vocabulary_metrics"](spark, tiny).first().asDict()
    assert (round(got["tokens_per_python_line"], 3), round(got["tokens_per_function"], 2), round(got["compression_ratio"], 3)) == (7.814, 19.50, 2.896)


def test_entry(spark):
    import __spark_entry__ as e

    assert {r["stage"] for r in e.entry(spark).collect()} >= {"exact_dedup", "near_dedup"}
    assert set(e.oracle_sql()) <= set(e.queries())
