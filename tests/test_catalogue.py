"""Every query of the catalogue against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue, kernels_catalogue, scale_catalogue, tables_catalogue  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df)].copy()
    for c in df:
        df[c] = df[c].astype(float).round(6) + 0.0 if df[c].dtype.kind in "fiub" else df[c].astype(str)
    return df.sort_values(list(df)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_equals_sql(spark, db, sf_dir, name):
    got, want = normal(catalogue.QUERIES[name](spark, sf_dir).toPandas()), normal(db.sql(catalogue.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, atol=2e-6)


def test_annotations_without_length_are_appended(spark, tmp_path):
    """Events of value 0 (none of them an error on the small tables), two of them alike, are intervals that start where they end."""
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(0, at(5.25), 1, "error", 0.0), (1, at(7.0), 1, "error", 2.5), (2, at(1.0), 1, "view", 0.0), (3, at(5.25), 1, "error", 0.0), (4, at(9.0), 2, "error", 0.0), (5, at(3.0), 3, "click", 1.0)]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = normal(catalogue.QUERIES["appended_annotations"](spark, str(tmp_path)).toPandas()), normal(c.sql(catalogue.ORACLES["appended_annotations"]).df())
    assert len(want) == 10
    pd.testing.assert_frame_equal(got, want, atol=2e-6)


def test_entry_module(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
