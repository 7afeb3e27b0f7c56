"""Every query with SQL gives the rows that DuckDB gives."""

import functools
import math

import duckdb
import pytest

from quern.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events".split()


def normal(rows, names, order):
    at = [names.index(n) for n in order]
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(fix(r[i]) for i in at) for r in rows), key=repr)


@functools.cache
def connected(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


#: At 0.01 more shares of cells lie about the limit.
LARGER = ["polygon_cells_of_boxes", "polygon_cells", "run_table"]


@pytest.mark.parametrize(("name", "scale"), [(n, "sf0.001") for n in plans.QUERIES] + [(n, "sf0.01") for n in LARGER])
def test_query(spark, name, scale):
    sf = f"/root/testdata/{scale}"
    db = connected(sf)
    df = plans.QUERIES[name](spark, sf)
    got = df.collect()
    assert got or name in ()
    if name in plans.SQL:
        rel = db.execute(plans.SQL[name])
        names = [d[0] for d in rel.description]
        rows = rel.fetchall()
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        assert normal(got, df.columns, order) == normal(rows, names, order)
