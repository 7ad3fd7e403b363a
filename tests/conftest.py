from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_tables():
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.fixture
def duck(duck_tables):
    """A cursor of its own for each test: what one leaves unread doesn't hold up the next."""
    with duck_tables.cursor() as cursor:
        yield cursor


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return repr(v)


def compare(df, relation) -> None:
    """Same columns, same rows in any order."""
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(c) for c in names]
    ours = sorted(tuple(canonical(r[c]) for c in names) for r in df.collect())
    theirs = sorted(tuple(canonical(r[i]) for i in at) for r in relation.fetchall())
    assert ours == theirs
