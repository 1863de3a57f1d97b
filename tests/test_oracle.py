"""Every registered query against its SQL in DuckDB."""

import pytest

from lakewright.catalogue import QUERIES, oracle_texts
from lakewright.catalogue.registry import Tables

from .compare import compare, duck
from .conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    assert compare(Tables(spark, SMALL), con, name) is None


def test_every_query_has_sql():
    assert set(oracle_texts()) == set(QUERIES)
