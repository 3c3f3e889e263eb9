"""Memory and history operators: visibility, exact merge, latest and prior turns, retention, overlays, diffs, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN_STATUS = ("quarantined", "superseded", "deleted")


def visible(memories: DataFrame, requester: str, owners: list[str] | None = None, restricted: bool = False) -> DataFrame:
    """Memories a requester may see: shared or own, of the owners, with a live status.

    On a restricted store no owners means no rows; on an open one it means no filter.
    """
    out = memories.where(((F.col("scope") != "private") | (F.col("agent") == requester)) & ~F.col("status").isin(*HIDDEN_STATUS))
    if owners:
        return out.where(F.col("agent").isin(*owners))
    return out.where(F.lit(False)) if restricted else out


def merge_exact(memories: DataFrame) -> DataFrame:
    """One memory a (digest, kind): the first by id, with how many rows and sessions it stands for."""
    return memories.groupBy("digest", "kind").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.count_distinct("session").alias("sessions"), F.min_by("agent", "id").alias("agent"))


def latest_per_session(messages: DataFrame) -> DataFrame:
    """The last message of each session: an aggregate, as only one row a session is wanted."""
    rest = [c for c in messages.columns if c != "session"]
    return messages.groupBy("session").agg(F.max_by(F.struct(*rest), "seq").alias("m")).select("session", "m.*")


def prior_prompt(messages: DataFrame) -> DataFrame:
    """Assistant messages with the last user message before them in the session."""
    w = Window.partitionBy("session", "agent").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prompt = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w)
    at = F.last(F.when(F.col("role") == "user", F.col("seq")), ignorenulls=True).over(w)
    return messages.withColumn("prompt_seq", at).withColumn("prompt", prompt).where("role = 'assistant'")


def window_around(messages: DataFrame, anchors: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Messages up to before and after positions from anchor messages (session, seq), with their distance."""
    placed = messages.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("seq")))
    at = placed.join(anchors.select("session", "seq"), ["session", "seq"], "left_semi").select("session", F.col("place").alias("anchor"))
    return placed.join(at, "session").withColumn("distance", F.col("place") - F.col("anchor")).where(F.col("distance").between(-before, after))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


#: What an outcome is worth. Fixed values.
OUTCOMES = {"useful": 1.0, "dead_end": -0.75, "corrected": -1.0}


def learning_overlay(signals: DataFrame, as_of: Column, half_life_days: float = 30.0) -> DataFrame:
    """node, score, signals, stale_signals and label from outcomes (node, outcome, ts, stale): each counts half as much every half-life.

    An outcome after as_of counts in full; an unknown one counts as a signal worth nothing. Weights (four digits) are summed
    as decimals and rounded once, so the score does not depend on the order of the sum.
    """
    age = (F.unix_micros(F.to_timestamp_ltz(as_of)) - F.unix_micros(F.to_timestamp_ltz(F.col("ts")))) / F.lit(86_400_000_000.0)
    weight = F.round(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / half_life_days), 4)
    value = F.lit(0).cast("decimal(3,2)")
    for outcome, worth in OUTCOMES.items():
        value = F.when(F.col("outcome") == outcome, F.lit(worth).cast("decimal(3,2)")).otherwise(value)
    worth = (value * weight.cast("decimal(5,4)")).cast("decimal(18,6)")
    s = signals.groupBy("node").agg(F.round(F.sum(worth), 4).cast("double").alias("score"), F.count("*").alias("signals"), F.count_if(F.col("stale")).alias("stale_signals"))
    return s.withColumn("label", F.when(F.col("score") >= 0.5, "preferred").when(F.col("score") <= -0.5, "contested").otherwise("tentative"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change (added, modified, removed) between manifests (path, digest)."""
    met = old.select("path", F.col("digest").alias("o")).join(new.select("path", F.col("digest").alias("n")), "path", "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return met.select("path", change.alias("change")).where("change is not null")


def retained(rows: DataFrame, as_of: Column, days: int, protected: Column) -> DataFrame:
    """Rows with whether retention keeps them: protected, or younger than days."""
    return rows.withColumn("kept", protected | (F.col("ts") >= as_of - F.expr(f"interval {days} days")))


def after_package(events: DataFrame, package: Column, read: Column, window: str = "1 hour") -> DataFrame:
    """Reads that follow a package of the same session within its window and before the next package.

    events: id, session, ts. An as-of pass: one window by session, no interval join.
    """
    w = Window.partitionBy("session").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(package, F.struct("id", "ts")), ignorenulls=True).over(w)
    return events.withColumn("package", last).where(read & F.col("package").isNotNull() & (F.col("ts") <= F.col("package.ts") + F.expr(f"interval {window}"))).select(F.col("package.id").alias("package_id"), F.col("id").alias("read_id"))


def resolve_alias(rows: DataFrame, stored: DataFrame, configured: DataFrame) -> DataFrame:
    """rows with agent resolved: stored alias, else configured alias, else itself; names folded."""
    a = stored.select(F.lower("alias").alias("k"), F.col("agent").alias("s"))
    b = configured.select(F.lower("alias").alias("k"), F.col("agent").alias("c"))
    return rows.withColumn("k", F.lower("agent")).join(a, "k", "left").join(b, "k", "left").withColumn("agent", F.coalesce("s", "c", "agent")).drop("k", "s", "c")


def claim_policy(
    status: Column, stale: Column, missing_dependencies: Column, execution_outcome: Column, execution_observed: Column, verification_level: Column, verified_metrics: Column, evidence: Column,
    evidence_type: Column,
) -> Column:
    """What may be claimed from a memory: the first case that holds, of twelve.

    verification_level may be null: then verified for a verified memory, else that of an imported report.
    """
    level = F.coalesce(verification_level, F.when(status == "verified", "verified").otherwise("imported_report"))
    return (
        F.when(stale, "stale").when(missing_dependencies, "evidence_missing").when(status == "contested", "contested").when(status == "proposed", "proposed_only")
        .when(execution_outcome == "failed", "execution_failed").when(execution_outcome == "cancelled", "execution_cancelled").when(execution_outcome == "timeout", "execution_timeout")
        .when(~F.coalesce(execution_observed, F.lit(False)) | level.isin("imported_report", "integrity_verified", "execution_declared"), "imported_only")
        .when((status != "verified") | ~F.coalesce(verified_metrics, F.lit(False)), "historical_only").when(~F.coalesce(evidence, F.lit(False)), "unsupported")
        .when(evidence_type == "benchmark", "verified_measured").otherwise("verified_fact")
    )


def paired(rows: DataFrame, task: str, variant: str, value: str, a: str, b: str) -> DataFrame:
    """Mean of value by task for two variants, where both exist, and their difference."""
    g = rows.where(F.col(variant).isin(a, b)).groupBy(task).agg(F.avg(F.when(F.col(variant) == a, F.col(value))).alias("a_mean"), F.avg(F.when(F.col(variant) == b, F.col(value))).alias("b_mean"))
    return g.where("a_mean is not null and b_mean is not null").withColumn("delta", F.col("b_mean") - F.col("a_mean"))


def run_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """runs, mean and half width of a 95 % interval (1.96 sd / sqrt n) by group."""
    n = F.count("*")
    return rows.groupBy(group).agg(n.alias("runs"), F.round(F.avg(value), 4).alias("mean"), F.round(F.lit(1.96) * F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(n), 4).alias("half_width"))
