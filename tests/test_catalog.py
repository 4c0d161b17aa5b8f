"""Each query of the catalogue against its SQL."""

import duckdb
import pytest

from strandlake.plans import catalog, catalog_reads  # noqa: F401 (the second adds to the first)

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def norm(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_and_sql_agree(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
