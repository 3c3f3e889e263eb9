"""A leased work queue as an append-only log: unique items, attempts, back-off, leases that run out.

Each change is a numbered folder with the new states of the items that it touches. A writer folds the log up to number n,
writes its change beside it and renames it to n + 1, which only one writer can: the other folds again. So a lease is always given on
the whole state, and two workers never hold one item. A worker that is lost just lets its lease run out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.sources.snapshots import _hadoop, move

STATE = "item string, status string, attempts int, worker string, until long, next_at long, error string, at long"


class Queue:
    """The queue in a folder. Times are seconds that the caller gives, so workers agree on them."""

    def __init__(self, spark: SparkSession, root: str, lease: int = 300, most_attempts: int = 3, back_off: int = 60) -> None:
        self.spark, self.root, self.lease, self.most_attempts, self.back_off = spark, root.rstrip("/"), lease, most_attempts, back_off

    def _last(self) -> int:
        """The number of the last change; each has a folder, which is named by it."""
        where, fs = _hadoop(self.spark, f"{self.root}/log")
        if not fs.exists(where):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()), default=0)

    def _fold(self, last: int) -> DataFrame:
        """The latest state of each item: one pass over the log, combined before the shuffle."""
        if not last:
            return self.spark.createDataFrame([], STATE)
        log = self.spark.read.schema(STATE).parquet(f"{self.root}/log/[0-9]*")
        log = log.withColumn("n", F.regexp_extract(F.input_file_name(), r"/log/(\d+)/", 1).cast("long")).where(F.col("n") <= last)
        columns = [c.split()[0] for c in STATE.split(", ")][1:]
        return log.groupBy("item").agg(F.max_by(F.struct(*columns), "n").alias("s")).select("item", "s.*")

    def state(self, now: int) -> DataFrame:
        """All items as they stand at now: a lease that has run out is queued again, or failed where no attempt is left."""
        out = self._fold(self._last())
        lost = (F.col("status") == "leased") & (F.col("until") <= now)
        status = F.when(lost & (F.col("attempts") >= self.most_attempts), "failed").when(lost, "queued").otherwise(F.col("status"))
        return out.withColumns({"status": status, "worker": F.when(~lost, F.col("worker")), "error": F.when(lost, "lease ran out").otherwise(F.col("error"))})

    def _change(self, make: Callable[[int], DataFrame]) -> DataFrame:
        """Append what make(last) gives to the log of that number; again from the start if another writer was first."""
        while True:
            last = self._last()
            temp = f"{self.root}/_new-{uuid.uuid4().hex}"
            make(last).select(*[c.split()[0] for c in STATE.split(", ")]).write.parquet(temp)
            try:
                _, fs = _hadoop(self.spark, self.root)
                fs.mkdirs(_hadoop(self.spark, f"{self.root}/log")[0])
                move(self.spark, temp, f"{self.root}/log/{last + 1:012d}", False)
            except Exception as error:
                if "FileAlreadyExists" not in str(error):
                    raise
                fs.delete(_hadoop(self.spark, temp)[0], True)
                continue
            return self.spark.read.schema(STATE).parquet(f"{self.root}/log/{last + 1:012d}")

    def put(self, items: DataFrame, now: int) -> int:
        """Queue items (item) that the queue has never had; how many there were."""

        def make(last: int) -> DataFrame:
            new = items.where("item is not null").select("item").distinct().join(self._fold(last).select("item"), "item", "left_anti")
            return new.selectExpr("item", "'queued' status", "0 attempts", "cast(null as string) worker", "cast(null as bigint) until", f"{now}L next_at", "cast(null as string) error", f"{now}L at")

        return self._change(make).count()

    def claim(self, worker: str, now: int, most: int) -> DataFrame:
        """Lease up to most items that are due, the longest due first, to a worker; those that it got."""

        def make(last: int) -> DataFrame:
            due = self._due(last, now).orderBy("next_at", "item").limit(most)
            return due.withColumns({"status": F.lit("leased"), "attempts": F.col("attempts") + 1, "worker": F.lit(worker), "until": F.lit(now + self.lease).cast("long"), "at": F.lit(now).cast("long"), "error": F.lit(None).cast("string")})

        return self._change(make).select("item", "attempts")

    def _due(self, last: int, now: int) -> DataFrame:
        lost = (F.col("status") == "leased") & (F.col("until") <= now) & (F.col("attempts") < self.most_attempts)
        return self._fold(last).where(((F.col("status") == "queued") & (F.col("next_at") <= now)) | lost)

    def finish(self, worker: str, items: DataFrame, now: int, error: str | None = None) -> int:
        """Close items (item) that the worker holds: done, or with an error queued again after a back-off that doubles, failed after the last attempt.

        An item whose lease has run out, or that another worker holds, is not changed; how many were.
        """

        def make(last: int) -> DataFrame:
            held = self._fold(last).where((F.col("status") == "leased") & (F.col("worker") == worker) & (F.col("until") > now)).join(items.select("item").distinct(), "item", "left_semi")
            again = F.when(F.col("attempts") >= self.most_attempts, "failed").otherwise("queued")
            wait = (F.lit(now) + F.lit(self.back_off) * F.pow(F.lit(2), F.col("attempts") - 1)).cast("long")
            return held.withColumns({"status": again if error else F.lit("done"), "next_at": wait if error else F.col("next_at"), "error": F.lit(error).cast("string"), "at": F.lit(now).cast("long"), "worker": F.lit(None).cast("string"), "until": F.lit(None).cast("long")})

        return self._change(make).count()
