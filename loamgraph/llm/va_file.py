"""Exact top-k search by inner product with a vector-approximation file.

Every distinct vector is stored twice: exactly, and as one byte a component, the number of its cell. A search scans the
cells alone. With a cell's centre m and half width w, the product with a query q lies within q.m -/+ |q|.w, so the scan
gives each vector a lower and an upper bound; what cannot reach the kth lower bound is left out. Exact vectors are then read
in waves, by falling upper bound, until the kth exact score lies above the upper bound of all that are left.

The marks between cells come from quantiles of a bounded sample (SAMPLE vectors by hash), the two outer cells reach to the
least and greatest value of all vectors; marks decide the speed, never the result. Queries go in blocks of about BLOCK
distinct vectors, the only thing that is held as a matrix; there are as many blocks as it takes.

Copies: equal vectors are one row of the file with their k + 1 smallest ids, which is all of them that a result can hold, so a
group of copies costs no more than a single vector, however large it is.

Defined results: vectors that are null or have a null or non-finite component take no part. A vector is compared with those
of its own length. Equal scores go to the smaller id, a null id comes last and is no query. Repeated rows (id and vector)
count once; another vector with the same id is a candidate like any other. Components are floored to longs (those beyond a
long's range are cut to it); a score beyond that range is null and comes last. Empty tables give no rows. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.llm.common import materialise, tidy

#: Cells a component, vectors in the sample for marks, distinct query vectors in a block.
CELLS, SAMPLE, BLOCK = 64, 10_000, 10_000
#: Rows of the file and queries that are compared at once.
ROWS, QUERIES = 4096, 256
#: Half the marks' sample that lies in neither outer cell ends at these quantiles.
TAIL = 0.002

Marks = dict[int, np.ndarray]


def whole_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as longs; null where a vector is null or has a null or non-finite component."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v)))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """row, v and ids, the k + 1 smallest ids, of each distinct vector of vectors (id, v): the exact file.

    Repeated rows are counted out before the shuffle, and only a task's own k + 1 smallest ids of a vector are shuffled
    (the limit on row_number is applied on both sides of it).
    """
    ids = vectors.dropDuplicates(["id", "v"])
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("id")))
    few = ids.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    grouped = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("held"))
    return materialise(grouped.select(F.monotonically_increasing_id().alias("row"), "v", F.col("held.id").alias("ids")), "exact-vectors")


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, positions and matrix of a batch's vectors, a length at a time."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    lengths = np.diff(ends)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, values[(ends[at][:, None] + np.arange(n))].astype(np.float64).reshape(len(at), n)


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for some in batches:
        for n, _, x in _by_length(some.column("v")):
            low, high = held.get(n, (x[0], x[0]))
            held[n] = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    rows = [(n, j, low[j], high[j]) for n, (low, high) in held.items() for j in range(n)]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["n", "j", "low", "high"])


def marks(exact: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> Marks:
    """The ends of the cells, by a vector's length: a matrix (component, cells + 1).

    The least and greatest values are over all vectors, a row a component; the rest comes from a bounded sample.
    """
    ends: dict[int, dict[int, tuple[float, float]]] = {}
    for r in exact.select("v").mapInArrow(_extremes, "n int, j int, low double, high double").groupBy("n", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # a row a component
        ends.setdefault(r["n"], {})[r["j"]] = (r["low"], r["high"])
    some: dict[int, list[list[int]]] = {}
    for r in exact.select("v").orderBy(F.xxhash64("v")).limit(sample).collect():
        some.setdefault(len(r["v"]), []).append(r["v"])
    out: Marks = {0: np.zeros((0, cells + 1))}  # vectors without components
    for n, of in ends.items():
        low, high = (np.array([of[j][i] for j in range(n)]) for i in (0, 1))
        near, far = (np.quantile(np.array(some[n], np.float64), q, axis=0) for q in (TAIL, 1 - TAIL)) if n in some else (low, high)
        inner = np.clip(np.ceil(np.linspace(near, far, cells - 1)), low, high).T
        out[n] = np.concatenate([low[:, None], inner, high[:, None]], axis=1)
    return out


def cell_file(exact: DataFrame, ends: Marks) -> DataFrame:
    """row, n (length) and cells, a byte a component, of each vector of the exact file: the approximation file.

    A value lies in the last cell whose lower end it reaches, which goes to the next end (values are whole) or, in the
    last cell, to the greatest value.
    """
    sent = exact.sparkSession.sparkContext.broadcast(ends)  # a row a component

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            cells: list[bytes] = [b""] * some.num_rows
            lengths = np.zeros(some.num_rows, np.int32)
            for n, at, x in _by_length(some.column("v")):
                own = np.empty(x.shape, np.uint8)
                for j in range(n):
                    own[:, j] = np.searchsorted(sent.value[n][j][1:-1], x[:, j], side="right")
                lengths[at] = n
                for i, row in zip(at, own, strict=True):
                    cells[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(lengths), pa.array(cells, pa.binary())], names=["row", "n", "cells"])

    return materialise(exact.select("row", "v").mapInArrow(run, "row long, n int, cells binary"), "cells")


def _scan(queries: dict[int, tuple[np.ndarray, np.ndarray]], ends: Marks, need: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bounds of a task's rows for each query (by length: rows, matrix): those that can be among its need best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: np.full((len(ids), need), -np.inf) for n, (ids, _) in queries.items()}
        # a query's products are sums of whole numbers; the slack covers their rounding where those are not exact
        slack = {n: 1e-13 * (np.abs(q) @ np.abs(ends[n]).max(axis=1, initial=0.0)) for n, (_, q) in queries.items() if n in ends}
        met: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                some = whole.slice(lo, ROWS)
                rows, lengths, cells = some.column("row").to_numpy(), some.column("n").to_numpy(), some.column("cells").to_pylist()
                for n in np.unique(lengths):
                    n = int(n)
                    if n not in queries:
                        continue
                    at = np.flatnonzero(lengths == n)
                    cell = np.frombuffer(b"".join(cells[i] for i in at), np.uint8).reshape(len(at), n)
                    j = np.arange(n)
                    low, high = ends[n][j, cell], ends[n][j, cell + 1]
                    centre, half = (low + high) / 2, (high - low) / 2
                    for a in range(0, len(queries[n][0]), QUERIES):
                        q = queries[n][1][a : a + QUERIES]
                        mid, room = q @ centre.T, np.abs(q) @ half.T + slack[n][a : a + QUERIES, None]
                        lower, upper = mid - room, mid + room
                        kept = np.concatenate([best[n][a : a + QUERIES], lower], axis=1)
                        best[n][a : a + QUERIES] = kth = -np.partition(-kept, need - 1, axis=1)[:, :need]
                        i, r = np.nonzero(upper >= kth.min(axis=1)[:, None])
                        met.append((n, i + a, rows[at[r]], lower[i, r], upper[i, r]))
        for n, i, r, lower, upper in met:
            stay = upper >= best[n].min(axis=1)[i]
            yield pa.RecordBatch.from_arrays([pa.array(queries[n][0][i[stay]]), pa.array(r[stay]), pa.array(lower[stay]), pa.array(upper[stay])], names=["query", "row", "lower", "upper"])
        tidy()

    return run


def candidates(cells: DataFrame, ends: Marks, queries: DataFrame, need: int, block: int = BLOCK) -> DataFrame:
    """query, row, upper and place: the rows of the file whose upper bound reaches the query's needth lower bound, by falling upper bound.

    queries (row, v) are distinct; each block of about block of them is a matrix that every task gets, and a scan of the file.
    """
    spark, found = cells.sparkSession, []
    blocks = max(1, -(-queries.count() // block))
    for b in range(blocks):
        by_length: dict[int, tuple[list[int], list[list[int]]]] = {}
        for r in queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "v").collect():  # one block
            rows, vectors = by_length.setdefault(len(r["v"]), ([], []))
            rows.append(r["row"])
            vectors.append(r["v"])
        sent = spark.sparkContext.broadcast({n: (np.array(rows, np.int64), np.array(vectors, np.float64).reshape(len(rows), n)) for n, (rows, vectors) in by_length.items()})
        found.append(materialise(cells.mapInArrow(lambda batches, sent=sent: _scan(sent.value, ends, need)(batches), "query long, row long, lower double, upper double"), "bounds"))
    bounds = found[0]
    for f in found[1:]:
        bounds = bounds.unionByName(f)
    low = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
    kth = bounds.withColumn("nth", low).where(F.col("nth") <= need).groupBy("query").agg(F.when(F.count("*") == need, F.min("lower")).alias("kth"))
    stay = bounds.join(kth, "query").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "row"))
    return materialise(stay.select("query", "row", "upper", place.alias("place")), "candidates")


def product(a: Column, b: Column) -> Column:
    """The inner product of two arrays of longs; null beyond a long's range."""
    return F.aggregate(F.zip_with(a, b, F.try_multiply), F.lit(0).cast("long"), F.try_add)


def exact_scores(found: DataFrame, exact: DataFrame, queries: DataFrame, need: int, first: int | None = None) -> DataFrame:
    """query, row and score of the candidates that had to be read: the needth best of each query is certain among them.

    Waves of candidates by falling upper bound, each eight times as many places as all before; a query is done when no
    upper bound that is left reaches its needth exact score.
    """
    q = queries.select(F.col("row").alias("query"), F.col("v").alias("q"))
    read, kth, lo, hi = None, None, 0, first or 4 * need
    while True:
        wave = found.where((F.col("place") > lo) & (F.col("place") <= hi))
        if kth is not None:
            wave = wave.join(kth, "query").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
        some = wave.select("query", "row").join(q, "query").join(exact.select("row", "v"), "row").select("query", "row", product(F.col("q"), F.col("v")).alias("score"))
        some = materialise(some, "scores")
        read = some if read is None else read.unionByName(some)
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("score")))
        kth = read.withColumn("nth", nth).where(F.col("nth") <= need).groupBy("query").agg(F.when(F.count("score") == need, F.min("score")).alias("kth"))
        left = found.where(F.col("place") > hi).join(kth, "query").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
        if left.isEmpty():
            return read
        lo, hi = hi, 8 * hi


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, cells: int = CELLS, sample: int = SAMPLE, block: int = BLOCK, first: int | None = None) -> DataFrame:
    """query_id, rank, id and score: the k best vectors (id, vector) of each query (id, vector), without the query's own row.

    Components become floor(256 * x); scores are inner products of those, exact.
    """
    given = vectors.select("id", whole_components(F.col("vector")).alias("v")).where("v is not null")
    asked = queries.select("id", whole_components(F.col("vector")).alias("v")).where("v is not null and id is not null").dropDuplicates(["id", "v"])
    exact = distinct_vectors(given, k)
    # a query's vector that is in the file has its row; others get numbers of their own, below 0
    known = materialise(asked.join(exact.select("v", "row"), "v", "left"), "queries")
    fresh = known.where("row is null").select("v").distinct().withColumn("own", -1 - F.monotonically_increasing_id())
    fresh = materialise(fresh, "new-queries")
    known = known.join(fresh, "v", "left").select("id", "v", F.coalesce("row", "own").alias("row")) if not fresh.isEmpty() else known
    distinct = known.select("row", "v").dropDuplicates(["row"])
    need = k + 1  # one of the best may be the query's own row
    ends = marks(exact, cells, sample)
    found = candidates(cell_file(exact, ends), ends, distinct, need, block)
    scores = exact_scores(found, exact, distinct, need, first)
    members = scores.join(exact.select("row", "ids"), "row").select("query", "score", F.explode("ids").alias("id"), (F.col("query") == F.col("row")).alias("same"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("id")))
    few = members.withColumn("best", best).where(F.col("best") <= need)
    met = known.select(F.col("id").alias("query_id"), F.col("row").alias("query")).join(few, "query").where(~(F.col("same") & F.col("id").eqNullSafe(F.col("query_id"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("best"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
