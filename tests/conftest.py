"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


def against_duckdb(frame, sql: str, folder: str, tables=("documents", "embeddings", "labels", "events", "lineitem", "orders", "part", "supplier", "customer", "nation", "region", "pages", "benchmark", "conversations")) -> None:
    """The frame's rows are those of the SQL on the same tables, in any order."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    a = sorted(repr([plain(r[c]) for c in order]) for r in frame.collect())
    b = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in order]) for r in want.fetchall())
    assert a == b


def plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if hasattr(x, "asDict"):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return [plain(y) for y in x.values()]
    return x
