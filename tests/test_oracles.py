"""Every query of the catalogue against its SQL, over whole tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from palimpsest.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    for c in df.columns:
        df[c] = df[c].map(lambda x: None if x is None else f"{x:.9g}" if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns), key=lambda s: s.fillna("")).reset_index(drop=True)


def test_every_query_has_its_sql():
    assert set(catalogue.queries()) == set(catalogue.oracles())


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    got = canonical(catalogue.queries()[name](spark, sf_dir).toPandas())
    want = canonical(duck.execute(catalogue.oracles()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert len(got) > 0 or sf_dir.endswith("sf0.001")
    pd.testing.assert_frame_equal(got, want)
