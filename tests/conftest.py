import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame) -> list:
    """Rows of a pandas frame as sorted tuples of plain values, columns by name."""
    import pandas as pd

    def plain(v):
        if v is None or (not isinstance(v, list | tuple | str | bytes) and not hasattr(v, "__len__") and pd.isna(v)):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return v.item() if hasattr(v, "item") else v

    out = [tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)]
    return sorted(out, key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL on the smallest tables."""

    def check(query, sql):
        a, b = query(spark, "/root/testdata/sf0.001").toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        a, b = rows(a), rows(b)
        assert [tuple(map(_number, r)) for r in a] == [tuple(map(_number, r)) for r in b]

    return check


def _number(v):
    return int(v) if isinstance(v, float) and v.is_integer() else v
