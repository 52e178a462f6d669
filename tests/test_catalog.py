"""Every catalogued query against its SQL."""

import duckdb
import pandas as pd
import pytest

from ledgerline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else str(pd.Timestamp(v)) if hasattr(v, "year") else round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert rows(got) == rows(want)
