"""Filter interaction audit: what each of five document filters removes, in every order in which they can be applied.

Every document gets the set of the filters that it fails (five bits). A precomputed table of 32 sets by 120 orders says at
which step of an order a set is removed first; tasks index it for their rows, count removals by part, order, step and label
with np.bincount, and send one row of partial arrays a part. All figures are sums over documents, so the partial arrays
add up to the result.

A: under 200 words; B: under half of the words are distinct; C: over 3 % of the characters are A to Z; D: holds one of
``#$%&*|``; E: the text of a smaller doc_id, anywhere in the table. Words are maximal runs without ASCII white space.

Defined results: a null text is an empty one, a null lang an empty part. A row without doc_id has no smaller doc_id and is
none, so it never fails E; repeated rows of one doc_id do not fail E through each other. A document is good (toxic) if any
of its label rows says so; other labels change nothing. An empty table gives no rows. Texts are read whole and one at a
time. Only the columns named here are read, so extra columns of any name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.llm.common import tidy
from loamgraph.llm.fingerprints import SPACE, bound

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: What is counted, in the order of the partial arrays.
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Bits of a row's label.
GOOD, TOXIC = 1, 2
#: Parts whose partial arrays a task holds before it sends them, and rows it counts at once.
HELD_PARTS, ROWS = 512, 2048


def first_failures() -> np.ndarray:
    """For every set of failed filters (bit i: filter i) and every order: the step, from 0, that removes it; 5 where none does."""
    sets, out = np.arange(1 << STEPS), np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            out[(sets >> FILTERS.index(order[step])) & 1 == 1, o] = step
    return out


def own_failures(text: Column) -> Column:
    """The bits of the filters A to D that a whole text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = lambda w: [F.size(w) < 200, 100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]
    return bound(words, lambda w: sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails(w))), F.lit(0)))


def failing_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How many documents (n) have a part, a set of failed filters and a label: part, failed, label, n; one key can have several rows.

    Texts become digests before anything is shuffled. Equal rows are counted before each shuffle, so a text that a
    third of all documents share reaches the step by digest as one row for each part, set and label.
    """
    told = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    small = told.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text")).alias("failed"))
    each = small.groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n"))
    bits = F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(bits.alias("label"))
    marked = each.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    known = F.col("doc_id").isNotNull()
    groups = marked.groupBy("digest", "part", "failed", "label").agg(
        F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("lone"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    firsts = F.col("lone") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    parted = groups.select("part", "failed", "label", "n", firsts.alias("firsts"))
    copy = 1 << FILTERS.index("E")
    rows = F.array(F.struct(F.col("failed"), F.col("firsts").alias("n")), F.struct((F.col("failed") + copy).alias("failed"), (F.col("n") - F.col("firsts")).alias("n")))
    return parted.select("part", "label", F.explode(rows).alias("r")).select("part", "r.failed", "label", "r.n").where("n > 0")


def _figures(counts: np.ndarray, sets: np.ndarray) -> list[np.ndarray]:
    """The partial arrays, by order and step, of counts (label, order, step or none) and of documents by set."""
    removed = counts.sum(axis=0)[:, :STEPS]
    held = (np.arange(len(sets))[:, None] >> np.arange(STEPS)) & 1
    fails, alone = sets @ held, sets[1 << np.arange(STEPS)]
    at = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    shapley = np.bincount(at.ravel(), weights=removed.ravel(), minlength=STEPS).astype(np.int64)
    good, toxic = (counts[[k for k in range(4) if k & bit], :, :STEPS].sum(axis=0) for bit in (GOOD, TOXIC))
    return [sets.sum() - removed.cumsum(axis=1), removed, fails[at] - removed, alone[at], good, toxic, shapley[at]]


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a part of what this task's rows (part, failed, label, n) add to each figure."""
    table, orders = first_failures(), np.arange(len(ORDERS))
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def send() -> pa.RecordBatch:
        figures = [_figures(*x) for x in held.values()]
        columns = [pa.array([f[k].ravel() for f in figures], pa.list_(pa.int64())) for k in range(len(FIGURES))]
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *columns], names=["part", *FIGURES])
        held.clear()
        return out

    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            some = whole.slice(at, ROWS)
            parts = some.column("part").dictionary_encode()
            names, code = parts.dictionary.to_pylist(), parts.indices.to_numpy().astype(np.int64)
            failed, label, n = (some.column(c).to_numpy().astype(np.int64) for c in ("failed", "label", "n"))
            flat = ((code * 4 + label)[:, None] * len(ORDERS) + orders) * (STEPS + 1) + table[failed]
            shape = (len(names), 4, len(ORDERS), STEPS + 1)
            counts = np.bincount(flat.ravel(), weights=np.repeat(n, len(ORDERS)), minlength=int(np.prod(shape))).astype(np.int64).reshape(shape)
            sets = np.bincount(code * len(table) + failed, weights=n, minlength=len(names) * len(table)).astype(np.int64).reshape(len(names), -1)
            for name, c, s in zip(names, counts, sets, strict=True):
                before = held.get(name)
                held[name] = (c, s) if before is None else (before[0] + c, before[1] + s)
            if len(held) > HELD_PARTS:
                yield send()
    if held:
        yield send()
    tidy()


def audit(sets: DataFrame) -> DataFrame:
    """part, filter_order, step and the figures of rows (part, failed, label, n): a row for each part, order and step, zeros included."""
    partial = sets.select("part", F.col("failed").cast("long").alias("failed"), F.col("label").cast("long").alias("label"), F.col("n").cast("long").alias("n"))
    arrays = partial.mapInArrow(_partials, "part string, " + ", ".join(f"{f} array<bigint>" for f in FIGURES))
    cells = arrays.select("part", F.posexplode(F.arrays_zip(*FIGURES)).alias("at", "cell")).select("part", "at", "cell.*")
    sums = cells.groupBy("part", "at").agg(*[F.sum(f).alias(f) for f in FIGURES])
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.floor(F.col("at") / STEPS) + 1).cast("int"))
    return sums.select("part", order.alias("filter_order"), (F.col("at") % STEPS + 1).cast("int").alias("step"), *FIGURES)
