"""Versions that fail or are damaged, leases of two workers, and fitted weights against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.functions.lineage import scratch
from loamgraph.operators import ranking as R
from loamgraph.sources import snapshots as S
from loamgraph.streaming.queue import Queue


def test_a_failed_refresh_leaves_the_old_version(spark):
    root = scratch(spark, "versions")
    one = S.commit(spark, root, {"nodes": spark.range(10), "edges": spark.range(3)})
    pinned = S.read(spark, root, "nodes")
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        S.commit(spark, root, {"nodes": spark.range(99), "edges": broken})
    assert S.current(spark, root) == one and S.read(spark, root, "nodes").count() == 10
    two = S.commit(spark, root, {"nodes": spark.range(20), "edges": spark.range(4)})
    assert S.read(spark, root, "nodes").count() == 20 and pinned.count() == 10 and two > one
    assert {r["state"] for r in S.verify(spark, root, one).collect()} == {"ok"}
    assert S.restore(spark, root, one) == S.current(spark, root) and S.read(spark, root, "edges").count() == 3


def test_a_damaged_version_is_refused(spark):
    from pathlib import Path

    root = scratch(spark, "damaged")
    one = S.commit(spark, root, {"nodes": spark.range(10).coalesce(1)})
    two = S.commit(spark, root, {"nodes": spark.range(5)})
    file = next(Path(root.removeprefix("file:"), one, "nodes").glob("part-*.parquet"))
    file.write_bytes(file.read_bytes()[:-9] + b"!" + file.read_bytes()[-8:])
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert [r["state"] for r in S.verify(spark, root, one).collect()] == ["changed"]
    with pytest.raises(S.SnapshotError, match="changed"):
        S.restore(spark, root, one)
    file.rename(file.with_name("part-other.parquet"))
    assert sorted(r["state"] for r in S.verify(spark, root, one).collect()) == ["extra", "missing"]
    assert S.current(spark, root) == two
    with pytest.raises(S.SnapshotError):
        S.verify(spark, root, "v-00000009-none")
    with pytest.raises(S.SnapshotError):
        S.read(spark, scratch(spark, "none"), "nodes")


def test_two_workers_never_hold_one_item(spark):
    from concurrent.futures import ThreadPoolExecutor

    q = Queue(spark, scratch(spark, "queue"), lease=100, most_attempts=2, back_off=10)
    items = spark.createDataFrame([(f"i{k:02d}",) for k in range(12)] + [("i00",), (None,)], "item string")
    assert q.put(items, 0) == 12 and q.put(items, 1) == 0
    with ThreadPoolExecutor(3) as pool:  # at once: the log takes them in turn
        got = list(pool.map(lambda w: {r["item"] for r in q.claim(w, 5, 4).collect()}, ["a", "b", "c"]))
    assert sum(map(len, got)) == 12 and len(set().union(*got)) == 12
    assert q.claim("d", 6, 5).count() == 0
    mine = spark.createDataFrame([(i,) for i in got[0]], "item string")
    assert q.finish("b", mine, 7) == 0  # not b's items
    assert q.finish("a", mine.orderBy("item").limit(2), 7) == 2
    assert q.finish("a", mine, 8, error="no answer") == 2
    told = {r["item"]: (r["status"], r["next_at"], r["attempts"]) for r in q.state(9).collect()}
    assert sorted(told[i] for i in got[0]) == [("done", 0, 1), ("done", 0, 1), ("queued", 18, 1), ("queued", 18, 1)]
    assert q.claim("d", 10, 5).count() == 0 and q.claim("d", 18, 5).count() == 2
    # b and c are lost: at 105 their leases have run out
    assert q.claim("e", 104, 20).count() == 0
    assert {r["item"] for r in q.claim("e", 105, 20).collect()} == got[1] | got[2]
    assert q.finish("b", spark.createDataFrame([(i,) for i in got[1]], "item string"), 106) == 0
    assert {r["status"] for r in q.state(300).where(F.col("item").isin(*got[1])).collect()} == {"failed"}
    assert q.claim("f", 300, 20).count() == 0


def plain_fit(x, right, request, ridge):
    w = np.zeros(x.shape[1])
    for _ in range(100):
        g, h = ridge * w, ridge * np.eye(len(w))
        for q in np.unique(request):
            at = request == q
            s = x[at] @ w
            e = np.exp(s - s.max())
            p, n = e / e.sum(), right[at].sum()
            m = p @ x[at]
            g = g + n * m - x[at][right[at]].sum(axis=0)
            h = h + n * ((x[at] * p[:, None]).T @ x[at] - np.outer(m, m))
        w = w - np.linalg.solve(h, g)
    return w


def test_weights_equal_a_plain_fit(spark):
    r = np.random.default_rng(8)
    x, request = r.normal(size=(400, 3)), r.integers(0, 30, 400)
    right = r.random(400) < 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0, 0.3]) - 1)))
    df = spark.createDataFrame([(int(q), bool(b), *map(float, v)) for q, b, v in zip(request, right, x, strict=True)], "request long, relevant boolean, f1 double, f2 double, f3 double")
    got = R.fit_weights(df, ["f1", "f2", "f3"], ridge=0.5)
    assert np.abs(np.array(list(got.values())) - plain_fit(x, right, request, 0.5)).max() < 1e-6
    assert R.fit_weights(df.limit(0), ["f1", "f2"]) == {"f1": 0.0, "f2": 0.0}
    top = R.rank_by_weights(df.withColumn("candidate", F.monotonically_increasing_id()), {"f1": 100.0, "f2": -3.0}, 2)
    assert top.groupBy("request").count().where("count > 2").count() == 0
