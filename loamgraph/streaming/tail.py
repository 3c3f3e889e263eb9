"""Incremental ingest: tailing JSON lines, idempotent appends, a cursor by session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "session string, seq long, role string, content string, ts string, id string, event_type string, metadata string"
#: An append-only table is dealt into so many folders by a hash of its keys, so a batch reads the keys of few of them.
BUCKETS = 64


def parse_lines(lines: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """Lines (value) as records with a state: ok, malformed or oversized; only ok rows have fields. Blank lines are left out.

    digest tells messages of a session and role apart: by the source's own id where there is one, else by content,
    metadata, event type and place.
    """
    big = F.octet_length("value") > most_bytes
    rec = F.from_json(F.when(~big, F.col("value")), RECORD)
    state = F.when(big, "oversized").when(F.col("r.content").isNull() | F.col("r.session").isNull(), "malformed").otherwise("ok")
    return lines.where(F.trim("value") != "").withColumn("r", rec).select(state.alias("state"), "r.*").withColumn("digest", F.sha2(F.encode(_identity(), "UTF-8"), 256))


def _identity() -> Column:
    part = lambda *names: F.concat_ws("\0", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
    return F.when(F.coalesce("id", F.lit("")) != "", F.concat(F.lit("id\0"), part("role", "id"))).otherwise(F.concat(F.lit("text\0"), part("content", "metadata", "event_type", "seq", "ts")))


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows of a batch whose keys the table at path lacks; each key once. A repeated batch adds nothing.

    The table has a folder a hash bucket of its keys (column bucket); only the batch's buckets are read.
    """
    spark = batch.sparkSession
    new = batch.dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    mine = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
    try:
        old = spark.read.parquet(path).where(F.col("bucket").isin(*mine)).select(*keys) if mine else None
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        old = None
    (new if old is None else new.join(old, keys, "left_anti").select(*new.columns)).write.mode("append").partitionBy("bucket").parquet(path)


def tail_json_lines(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Take in all new files of JSON lines once and stop; the checkpoint is the cursor, the digest makes repeats harmless."""
    lines = spark.readStream.schema("value string").text(folder)
    done = parse_lines(lines).writeStream.foreachBatch(lambda b, _: append_new(b.where("state = 'ok'"), table, ["session", "role", "digest"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input directory as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def action_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events by tumbling window and type; rows later than the watermark are not counted in a running stream."""
    return events.withColumn("at", F.to_timestamp_ltz("ts")).withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("events"))


def stream_cursor(messages: DataFrame, most_tokens: int = 12_000, most_rows: int = 30) -> DataFrame:
    """A streaming cursor by session: how many messages are compacted, in how many batches, and the last seq, kept as state.

    Each run goes on from the cursor, batch after batch of at most most_rows messages and most_tokens tokens (a longer
    message is a batch of its own), until no message is left. A seq at or below the cursor is a repeat.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = T.StructType([T.StructField(c, T.LongType()) for c in ("session", "last_seq", "messages", "batches")])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, batches = state.get if state.exists else (-1, 0, 0)
        new = pd.concat(list(frames))[["seq", "content"]]
        new = new[new["seq"] > last].drop_duplicates("seq").sort_values("seq")
        costs = [max(1, len(str(c or "").encode("utf-8", "surrogatepass")) // 4) for c in new["content"]]
        batches += len(_batches(costs, most_tokens, most_rows))
        if len(new):
            last, n = int(new["seq"].max()), n + len(new)
        state.update((last, n, batches))
        yield pd.DataFrame([(key[0], last, n, batches)], columns=["session", "last_seq", "messages", "batches"])

    return messages.groupBy("session").applyInPandasWithState(run, out, "last_seq long, messages long, batches long", "update", GroupStateTimeout.NoTimeout)


def _batches(costs: list[int], most_tokens: int, most_rows: int) -> list[tuple[int, int]]:
    """Tokens and rows of consecutive batches that take all costs."""
    out: list[tuple[int, int]] = []
    for c in costs:
        if out and out[-1][0] + c <= most_tokens and out[-1][1] < most_rows:
            out[-1] = (out[-1][0] + c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out
