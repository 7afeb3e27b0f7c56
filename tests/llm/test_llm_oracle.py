"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES


def normal(rows):
    """Rows in order; doubles to nine places."""
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert normal(QUERIES[name](spark, sf).select(*names).collect()) == normal(rel.fetchall())


def test_something_is_rejected(spark):
    """The data of the comparison has pages and documents that the methods themselves turn down."""
    sf = "/root/testdata/sf0.01"
    assert QUERIES["op1_url_filter"](spark, sf).where("rule is null and verdict = 'block'").count() > 0
    assert QUERIES["op7_quality_rules"](spark, sf).where("n_removed_words > 0").count() > 50
