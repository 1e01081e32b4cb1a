from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

#: The smallest tables of the driver.
TABLES = Path(os.environ.get("GRIDLOOM_TABLES", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    if not TABLES.exists():
        pytest.skip("the driver's tables are not here")
    return str(TABLES)


@pytest.fixture(scope="session")
def duck(tables):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in sorted(Path(tables).iterdir()):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def same_rows(df, con, sql: str) -> None:
    """The rows of df are those of the SQL, whatever their order."""

    def plain(v):
        return "nan" if isinstance(v, float) and v != v else v + 0.0 if isinstance(v, float) else v

    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want
