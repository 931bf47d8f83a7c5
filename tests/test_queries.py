"""Every registered query of the table library against its DuckDB SQL."""

from __future__ import annotations

import pytest

from tidemark.queries import QUERIES, SQL

from .compare import connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    names, expected = duck_rows(con, SQL[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == expected
