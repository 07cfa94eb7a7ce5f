"""Every registered query with a SQL counterpart against DuckDB; the others must give rows."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    count, problems = oracle.compare(spark, con, QUERIES[name], SQL[name], SF)
    assert not problems, "\n".join(problems)
    assert count > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "line_no", "keywords", "cnt"]
