"""Every registered retrieval query against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from brevia import tables
from brevia.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shape(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v))
    return sorted(map(tuple, df.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, sf, name):
    out = catalogue.QUERIES[name](spark, sf)
    a = pd.DataFrame([tuple(r) for r in out.collect()], columns=out.columns, dtype=object)
    tables.drop_all(spark)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = con.execute(catalogue.ORACLES[name])
    b = pd.DataFrame(r.fetchall(), columns=[c[0] for c in r.description], dtype=object)
    assert sorted(a.columns) == sorted(b.columns)
    assert shape(a) == shape(b)
