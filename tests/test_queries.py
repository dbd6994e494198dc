"""Every query with SQL against DuckDB on the smallest tables, and the others for rows of a stable schema."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from pagemill.plans import registry

DATA = os.environ.get("PAGEMILL_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if hasattr(x, "__len__") and not isinstance(x, str):
            return str(list(x))
        if pd.isna(x):
            return None
        return round(float(x), 6) if not isinstance(x, str) else x

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_partitioning_does_not_matter(spark):
    from pagemill.operators import assembly

    results = spark.read.parquet(f"{DATA}/page_results.parquet")
    one = assembly.text_fingerprint(assembly.page_texts(results.repartition(1)))
    seven = assembly.text_fingerprint(assembly.page_texts(results.repartition(7)))
    assert rows(one.toPandas()) == rows(seven.toPandas())
