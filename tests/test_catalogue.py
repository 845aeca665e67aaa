"""Every query with SQL gives DuckDB's rows; the others run."""

import pytest

from quillmark.plans import catalogue, language  # noqa: F401  language registers its queries in the catalogue

from .oracle import same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.ORACLE[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() >= (name != "noise_override")


def test_entry_is_lazy_and_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
