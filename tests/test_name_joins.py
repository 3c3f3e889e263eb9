"""Joins by name against plain definitions, on odd rows and on one name that all calls and symbols share."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loamgraph.operators import graph as G
from loamgraph.operators import references
from loamgraph.operators import resolve as V
from loamgraph.operators import traverse as T
from loamgraph.plans import graph_queries as Q
from tests.conftest import SF

CALLS, SYMBOLS = "call_id long, name string, file string, container string, arity int", "id string, name string, file string, container string, arity int"


def _rows(seed, n, ids):
    rng = random.Random(seed)
    pick = lambda xs: rng.choice([*xs, None]) if rng.random() < 0.9 else None
    return [(ids(rng, i), pick("pqr"), pick("fgh"), pick("cd"), pick([1, 2, 3, 5])) for i in range(n)]


def _one_name(spark, n=60_000):
    k = F.col("id")
    text = lambda x: F.concat(F.lit("x"), (k % x).cast("string"))
    return spark.range(n).select(k, F.lit("same").alias("name"), text(7).alias("file"), text(5).alias("container"), (k % 3).cast("int").alias("arity"), text(5).alias("module"))


def test_evidence_of_names_in_all_combinations(spark):
    calls, symbols = _rows(1, 250, lambda rng, i: rng.randrange(220)), _rows(2, 60, lambda rng, i: f"s{i}")
    got = Counter(tuple(r) for r in G.resolve_names(spark.createDataFrame(calls, CALLS), spark.createDataFrame(symbols, SYMBOLS)).collect())
    met = defaultdict(list)
    for c, n, f, o, a in calls:
        for i, sn, sf, so, sa in symbols:
            if n is not None and n == sn:
                near = 0 if a is None or sa is None else 5 if a == sa else 3 if abs(a - sa) == 1 else 0
                met[c].append((4 * (f is not None and f == sf) + 5 * (o is not None and o == so) + near, i))
    want = Counter()
    for c, found in met.items():
        top = [x for x in found if x[0] == max(found)[0]]
        if len(top) <= 4:
            want.update((c, i, s, len(top), "AMBIGUOUS" if len(top) > 1 else "EXTRACTED") for s, i in top)
    assert got == want and len(want) > 20


def test_one_name_for_all_does_not_meet_row_by_row(spark):
    calls, symbols = _one_name(spark).withColumnRenamed("id", "call_id"), _one_name(spark).withColumn("id", F.col("id").cast("string"))
    assert G.resolve_names(calls, symbols.select("id", "name", "file", "container", "arity")).count() == 0
    one = V.routes(calls.select(F.col("call_id").alias("route_id"), "name", "container"), symbols).groupBy("preference").count().collect()
    assert [tuple(r) for r in one] == [(0, 60_000)]
    ties = V.candidate_ties(calls, symbols).groupBy("candidates", "best_ties").count().collect()
    assert [tuple(r) for r in ties] == [(60_000, 12_000, 60_000)]
    bases = symbols.select(F.col("id").alias("child"), F.lit("a::same").alias("written"), "file")
    assert V.inheritance(bases, symbols.select("id", "name", F.lit("class").alias("kind"), "file")).count() == 0
    own = symbols.select("id", "name", "module", F.concat(F.lit("only"), "id").alias("target_file"))
    asked = calls.select("call_id", F.concat(F.lit("only"), F.col("call_id").cast("string")).alias("file"), "name")
    assert V.imported_candidates(asked, own, calls.select("call_id", "module")).where(F.col("call_id").cast("string") == F.col("id")).count() == 60_000


def test_sides_that_grow_with_symbols_are_not_collected_in_the_driver(spark):
    symbols = spark.createDataFrame([("a", "n", "f", "c", 1), (None, "n", None, None, 3), ("z", "m", None, "c", 9)], SYMBOLS)
    calls = spark.createDataFrame([(1, "n", "f", None, None), (2, "n", None, None, 3), (3, "m", "g", "c", None)], CALLS)
    out = G.resolve_names(calls, symbols)
    assert {tuple(r) for r in out.collect()} == {(1, "a", 4, 1, "EXTRACTED"), (2, None, 5, 1, "EXTRACTED"), (3, "z", 5, 1, "EXTRACTED")}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    query = Q.graph_resolve_names(spark, SF)  # tables of any size: the small ones here are far below the limit of a broadcast
    query.collect()
    assert "Broadcast" not in query._jdf.queryExecution().executedPlan().toString()


def test_imported_candidates_are_those_of_the_filter(spark):
    calls = spark.createDataFrame([(r[0], r[2], r[1]) for r in _rows(3, 120, lambda rng, i: i)], "call_id long, file string, name string")
    symbols = spark.createDataFrame([(r[0], r[1], r[3], r[2]) for r in _rows(4, 30, lambda rng, i: f"s{i}")], "id string, name string, module string, target_file string")
    imports = spark.createDataFrame([(i, "cd"[i % 2]) for i in range(0, 120, 3)] * 2, "call_id long, module string")
    want = V.import_filter(calls.join(symbols, "name").drop("name"), imports).select("call_id", "id")
    assert Counter(map(tuple, V.imported_candidates(calls, symbols, imports).collect())) == Counter(map(tuple, want.collect()))


def test_calls_of_a_key_follow_each_other_in_the_files_of_the_result(spark, tmp_path):
    calls = spark.range(60_000).select(F.col("id").alias("call_id"), F.concat(F.lit("f"), (F.col("id") % 40).cast("string")).alias("file"), (F.col("id") % 90).alias("name"))
    symbols = spark.range(120_000).select((F.col("id") * 7919 % 10**9).alias("id"), (F.col("id") % 90).alias("name"), F.lit("m").alias("module"), F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("target_file"))
    out = V.imported_candidates(calls, symbols, calls.where("call_id < 0").select("call_id", F.lit("m").alias("module")))
    out.write.parquet(str(tmp_path / "out"))
    size, rows = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")), spark.read.parquet(str(tmp_path / "out")).count()
    assert rows > 5_000_000 and size < 0.6 * rows, (rows, size)


def test_ties_and_bases_of_odd_rows(spark):
    symbols = _rows(5, 40, lambda rng, i: f"s{i % 33}")
    calls = _rows(6, 60, lambda rng, i: rng.randrange(50))
    met = defaultdict(list)
    for c, n, _, o, _ in calls:
        met[c] += [4 * (o is not None and o == so) for _, sn, _, so, _ in symbols if n is not None and n == sn]
    want = {(c, len(x), x.count(max(x))) for c, x in met.items() if x}
    as_module = lambda rows, k: spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], f"{k}, name string, module string")
    assert {tuple(r) for r in V.candidate_ties(as_module(calls, "call_id long"), as_module(symbols, "id string")).collect()} == want
    bases = [(f"s{c}", f"a::{n}", f) for c, n, f, _, _ in calls if n]
    by = defaultdict(list)
    for c, w, f in bases:
        by[c, w] += [(4 * (f is not None and f == sf), i, k) for i, n, sf, k, _ in symbols if n == w[3:] and i != c]
    want = Counter()
    for (c, _), found in by.items():
        top = [x for x in found if x[0] == max(y[0] for y in found)]
        if len(top) <= 4:
            want.update((c, i, "implements" if k == "c" else "inherits", "AMBIGUOUS" if len(top) > 1 else "EXTRACTED" if s else "INFERRED") for s, i, k in top)
    kinds = spark.createDataFrame([(i, n, "interface" if k == "c" else "class", f) for i, n, f, k, _ in symbols], "id string, name string, kind string, file string")
    assert Counter(map(tuple, V.inheritance(spark.createDataFrame(bases, "child string, written string, file string"), kinds).collect())) == want


def test_spans_of_one_file_are_met_in_pieces(spark):
    rng = random.Random(7)
    spans = [("f", f"n{i}", (s := rng.randrange(1, 400)), rng.choice([0, s, s + rng.randrange(90), s - 2])) for i in range(150)]
    points = [("f", line, line - rng.randrange(2)) for line in range(1, 420, 3)] + [("g", 5, 5)]
    got = {(r["file"], r["line"]): (r["inner"] and tuple(r["inner"]), r["last"] and tuple(r["last"])) for r in references.held(spark.createDataFrame(points, "file string, line long, top long"), spark.createDataFrame(spans, "file string, name string, start long, end long"), 16).collect()}
    for file, line, top in points:
        above = [(s, n, e) for f, n, s, e in spans if f == file and s <= top]
        inner = [(s, n) for s, n, e in above if e == 0 or e >= line]
        assert got[file, line] == (max(inner, default=None), max([x[:2] for x in above], default=None))
    # one file of 60,000 symbols and as many points, which would be 1.8 thousand million pairs
    n = spark.range(60_000).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    symbols = n.select("file", F.concat(F.lit("s"), F.col("line").cast("string")).alias("name"), F.col("line").alias("start"), F.col("line").alias("end"))
    assert references.held(n.withColumn("top", F.col("line")), symbols).where(F.expr("inner.start = line and last.start = line")).count() == 60_000


def test_division_by_groups_of_all_sizes(spark):
    rng = random.Random(8)
    have = {(o, i) for o in range(30) for i in range(12) if rng.random() < 0.7}
    groups = {g: set(rng.sample(range(13), 1 + g % 4)) for g in range(60)}
    got = G.covers(spark.createDataFrame([*have], "owner int, item int"), spark.createDataFrame([(g, i) for g, x in groups.items() for i in x], "group int, item int")).collect()
    assert Counter(map(tuple, got)) == Counter((o, g) for o in range(30) for g, x in groups.items() if all((o, i) in have for i in x))


def test_least_of_the_shortest_paths_without_a_table_of_all_paths(spark):
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)]
    edges = spark.createDataFrame([(a, b, "uses", "EXTRACTED", "f", 1) for a, b in pairs], "source string, target string, label string, confidence string, file string, line int")
    for goal, most in (("n7", 8), ("n9", 3), ("n1", 2), ("none", 8), ("n0", 0)):
        paths = [["n0"]]
        for _ in range(most):
            if any(p[-1] == goal for p in paths):
                break
            seen = {x for p in paths for x in p}
            paths = sorted(p + [y] for p in paths for a, b in pairs for x, y in ((a, b), (b, a)) if x == p[-1] and y not in p)
        want = min((p for p in paths if p[-1] == goal), default=[])
        assert [r["id"] for r in T.shortest_path(edges, "n0", goal, most).orderBy("step").collect()] == want
