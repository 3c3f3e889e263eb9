"""A small local session for all tests."""

from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp()}")
        .config("spark.executorEnv.PYTHONPATH", str(Path(__file__).resolve().parent.parent))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the small tables as views."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def normal(frame) -> list[tuple]:
    """Rows of a pandas frame in an order and form that two engines share."""
    out = []
    frame = frame.astype(object).where(frame.notna(), None)
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(int(v)) if hasattr(v, "__int__") and not isinstance(v, (str, bool)) and hasattr(v, "bit_length") else str(v) for v in row))
    return sorted(out)
