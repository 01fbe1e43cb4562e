"""Every query with an oracle gives its rows; the others run and keep their invariants."""

import duckdb
import pytest

from quayside import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"windowed_fifo_waves", "mp_waves", "adaptive_waves"}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    return sorted((tuple(r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).to_numpy().tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_meets_its_oracle(spark, sf_dir, db, name):
    got, expected = catalogue.QUERIES[name](spark, sf_dir).toPandas(), db.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got, sorted(got.columns)) == rows(expected, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - SLOW))
def test_query_without_oracle_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_registries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
