"""Versions of tables: written beside the current one, checked, and made current by one swap; readers keep the version they began with.

A version is a folder with a table each and a manifest of all files with their size and SHA-256. The file CURRENT names the version
that readers get. It is replaced by a rename after the manifest is complete, so a write that fails, at whatever point, leaves
the old version current and whole. One writer at a time: a swap whose base is no longer current is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, MANIFEST = "CURRENT", "_manifest"


class SnapshotError(Exception):
    """A version that is missing or damaged, or a swap that came too late."""


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def move(spark: SparkSession, source: str, target: str, replace: bool) -> None:
    """Rename source to target in one step; without replace an existing target is an error."""
    a, _ = _hadoop(spark, source)
    b, _ = _hadoop(spark, target)
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE if replace else kinds.NONE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), spark._jsc.hadoopConfiguration()).rename(a, b, options)


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the current version; none before the first commit."""
    where, fs = _hadoop(spark, f"{root}/{POINTER}")
    if not fs.exists(where):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()["value"]


def _point(spark: SparkSession, root: str, version: str, base: str | None) -> None:
    temp = f"{root}/_{POINTER}-{uuid.uuid4().hex}"
    where, fs = _hadoop(spark, temp)
    out = fs.create(where)
    out.write(bytearray(version.encode()))
    out.close()
    if current(spark, root) != base:
        fs.delete(where, False)
        raise SnapshotError(f"{root}: another version has become current since {base}")
    move(spark, temp, f"{root}/{POINTER}", True)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """table, file, bytes and sha256 of all data files of a version, read in executors, a file a row."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    told = found.select(F.element_at(parts, -2).alias("table"), F.element_at(parts, -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return told.where(F.col("table") != MANIFEST)


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], rows_a_file: int = 5_000_000) -> str:
    """Write tables as a new version, then make it current; returns its name. rows_a_file bounds what one checksum reads."""
    base = current(spark, root)
    number = int(base.split("-")[1]) + 1 if base else 1
    version = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(f"{root}/{version}/{name}")
    _files(spark, f"{root}/{version}").write.parquet(f"{root}/{version}/{MANIFEST}")
    _point(spark, root, version, base)
    return version


def read(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a version (the current one at the time of the call); later commits do not change what it reads."""
    at = version or current(spark, root)
    if at is None:
        raise SnapshotError(f"{root} has no version")
    return spark.read.parquet(f"{root}/{at}/{name}")


def verify(spark: SparkSession, root: str, version: str) -> DataFrame:
    """table, file and state of all files of a version: ok, changed, missing or extra. A version without a manifest was never complete: an error."""
    folder = f"{root}/{version}"
    where, fs = _hadoop(spark, f"{folder}/{MANIFEST}/_SUCCESS")
    if not fs.exists(where):
        raise SnapshotError(f"{folder} is not complete")
    want = spark.read.parquet(f"{folder}/{MANIFEST}").withColumn("w", F.lit(1))
    have = _files(spark, folder).select("table", "file", F.col("sha256").alias("now"), F.col("bytes").alias("size"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("w").isNull(), "extra").when((F.col("now") != F.col("sha256")) | (F.col("size") != F.col("bytes")), "changed").otherwise("ok")
    return want.join(have, ["table", "file"], "full").select("table", "file", state.alias("state"))


def restore(spark: SparkSession, root: str, version: str) -> str:
    """Make an earlier version current again, after all its files have been verified."""
    bad = verify(spark, root, version).where("state <> 'ok'")
    some = bad.orderBy("table", "file").limit(3).collect()
    if some:
        raise SnapshotError(f"{version}: " + ", ".join(f"{r['table']}/{r['file']} {r['state']}" for r in some))
    _point(spark, root, version, current(spark, root))
    return version
