"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from alertloom.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(pdf):
    pdf = pdf.reindex(sorted(pdf.columns), axis=1)
    out = []
    for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
        out.append(tuple(v if v is None else f"{v:.6f}" if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, float) else str(v) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got)
    if name in ORACLE:
        want = con.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
