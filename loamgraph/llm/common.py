"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loamgraph.functions.lineage import shared_dir
from loamgraph.functions.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input directory, read by Spark alone (any file system); executors learn of this package first."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    The folder is deleted when the driver ends, as results that are read lazily may need it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df, from file sizes; costs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tidy() -> None:
    """Give memory that a task has freed back to the system: Python workers live on after it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with underscores before it until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def annotate(df: DataFrame, make: Callable[[], Callable[[list[str | None]], list[pa.Array]]], fields: list[tuple[str, str]], text: str = "text", batch: int = 128) -> DataFrame:
    """df with new columns (name, type) computed from its text column alone, in Arrow batches.

    make() is called once a task and returns the function from texts to the new columns. Input columns with the
    name of a new one are replaced.
    """
    names = [n for n, _ in fields]
    kept = df.select(*[f"`{c}`" for c in df.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in fields)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                some = whole.slice(at, batch)
                new = fn(some.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, *new], names=[*some.schema.names, *names])
        del fn
        tidy()

    return kept.mapInArrow(run, schema)
