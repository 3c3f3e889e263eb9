"""Graph operators on hand-made graphs."""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import functions as F

from loamgraph.functions import paths
from loamgraph.operators import graph as G
from loamgraph.operators import impact as P
from loamgraph.operators import traverse as T
from loamgraph.plans import intent as I

EDGE = "source string, target string, label string, confidence string, file string, line long, candidates long, resolution_score double"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, label, c, f, n, k, 0.0) for a, b, label, c, f, n, k in rows], EDGE)


def nodes(spark, ids):
    return spark.createDataFrame([(i, "symbol", i.upper(), f"src/{i}.py", 1, "box") for i in ids], "id string, kind string, name string, file string, line long, container string")


def test_dedup_keeps_the_strongest(spark):
    e = edges(spark, [("a", "b", "uses", "AMBIGUOUS", "f", 1, 3), ("a", "b", "uses", "EXTRACTED", "f", 1, 1), ("a", "b", "uses", "INFERRED", "f", 1, 1), ("a", "c", "uses", "INFERRED", None, None, 2)])
    got = {r["target"]: r for r in G.dedup_edges(e).collect()}
    assert got["b"]["confidence"] == "EXTRACTED" and got["b"]["occurrences"] == 3 and got["b"]["confidence_score"] == 0.86
    assert got["c"]["confidence_score"] == 0.52


def test_induced_has_no_dangling_edge(spark):
    e = edges(spark, [("a", "b", "uses", "EXTRACTED", None, None, 1), ("b", "x", "uses", "EXTRACTED", None, None, 1)])
    assert [(r["source"], r["target"]) for r in G.induced(nodes(spark, "ab"), e).collect()] == [("a", "b")]


def test_hops_end_in_a_cycle_and_ignore_self_loops(spark):
    e = edges(spark, [("a", "b", "uses", "EXTRACTED", None, None, 1), ("b", "c", "uses", "EXTRACTED", None, None, 1), ("c", "a", "uses", "EXTRACTED", None, None, 1), ("a", "a", "uses", "EXTRACTED", None, None, 1)])
    got = {r["id"]: r["hop"] for r in T.neighborhood(nodes(spark, "abc"), e, "A", 9).collect()}
    assert got == {"a": 0, "b": 1, "c": 1}


def test_blast_radius_follows_consumers_only(spark):
    e = edges(spark, [("user", "lib", "uses", "EXTRACTED", None, None, 1), ("lib", "base", "uses", "EXTRACTED", None, None, 1), ("far", "user", "uses", "INFERRED", None, None, 1)])
    got = {r["id"]: (r["hop"], r["via"]) for r in T.blast_radius(nodes(spark, ["user", "lib", "base", "far"]), e, "lib", 2).collect()}
    assert got == {"user": (1, "lib"), "far": (2, "user")}


def test_no_match_reaches_nothing(spark):
    assert T.blast_radius(nodes(spark, "ab"), edges(spark, []), "zzz").count() == 0


def test_shortest_path_equals_plain_search(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("x", "y")]
    e = edges(spark, [(a, b, "uses", "EXTRACTED", None, None, 1) for a, b in pairs])
    near: dict[str, list[str]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    queue, best = deque([["a"]]), None
    while queue and best is None:
        p = queue.popleft()
        best = p if p[-1] == "d" else None
        queue.extend([*p, n] for n in sorted(near[p[-1]]) if n not in p)
    assert [r["id"] for r in T.shortest_path(e, "a", "d").orderBy("step").collect()] == best
    assert T.shortest_path(e, "a", "y").count() == 0


def test_labels_tie_to_the_least(spark):
    p = spark.createDataFrame([("a", "b", 2), ("b", "c", 2), ("d", "e", 5)], "a string, b string, weight long")
    got = {r["id"]: r["community"] for r in T.propagate_labels(p, 4).collect()}
    assert got["d"] == got["e"] and got["a"] != got["d"]
    assert got == {r["id"]: r["community"] for r in T.propagate_labels(p, 4).collect()}


def test_division_and_ties(spark):
    have = spark.createDataFrame([("s1", "p1"), ("s1", "p2"), ("s2", "p1")], "owner string, item string")
    need = spark.createDataFrame([("o1", "p1"), ("o1", "p2"), ("o2", "p1")], "`group` string, item string")
    assert {(r["owner"], r["group"]) for r in G.covers(have, need).collect()} == {("s1", "o1"), ("s1", "o2"), ("s2", "o2")}


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("u", 5, "five"), ("u", 2, "two")], "k string, s int, value string")
    got = {r["id"]: r["value"] for r in G.latest_before(left, right, ["k"], "t", "s", "value").collect()}
    assert got == {1: "five", 2: None, 3: None}


def test_narrowest_span_wins(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 100), ("f", "inner", 10, 20)], "file string, id string, start long, end long")
    points = spark.createDataFrame([("f", 1, 15), ("f", 2, 50), ("f", 3, 500)], "file string, point_id int, line long")
    assert {r["point_id"]: r["id"] for r in G.enclosing(points, spans).collect()} == {1: "inner", 2: "outer"}


def test_scopes(spark):
    rows = [("src/a.py",), ("a/tests/b.py",), ("legacy/tests/b.py",), ("x/backup_old/c.py",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(paths.scope(F.col("p"))).collect()]
    assert got == ["production", "tests", "legacy", "legacy", "production", "production"]


def test_greedy_cover_and_merge_order():
    assert I.greedy_cover({"a": {"1", "2"}, "b": {"2", "3", "4"}, "c": {"1"}}) == ["b", "a"]
    assert I.greedy_cover({}) == []
    assert I.merge_order([{"name": "x", "after": ["y"]}, {"name": "y", "conflicts": 3}, {"name": "z", "conflicts": 1}]) == ["z", "y", "x"]
    assert I.merge_order([{"name": "p", "after": ["q"]}, {"name": "q", "after": ["p"], "conflicts": 1}]) == ["p", "q"]


def test_reviews_and_types(spark):
    e = edges(spark, [("a", "b", "uses", "AMBIGUOUS", None, None, 1), ("a", "c", "uses", "AMBIGUOUS", None, None, 1), ("b", "c", "uses", "EXTRACTED", None, None, 1)])
    d = spark.createDataFrame([("a", "b", "uses", "accepted"), ("a", "c", "uses", "rejected"), ("b", "c", "uses", "rejected")], "source string, target string, label string, decision string")
    assert {(r["target"], r["confidence"]) for r in G.apply_reviews(e, d).collect()} == {("b", "REVIEWED"), ("c", "EXTRACTED")}
    side = spark.createDataFrame([("a", "b", "uses"), ("a", "nope", "uses")], "source string, target string, label string")
    good, bad = G.merge_typed(e, side, nodes(spark, "abc"))
    assert good.where("confidence = 'TYPED'").count() == 1 and bad.count() == 1


def test_god_nodes_leave_out_tests_containers_and_homonyms(spark):
    rows = [("a", "symbol", "run", "src/a.py", 1), ("b", "symbol", "testRun", "src/b.py", 1), ("c", "region", "run", "src/c.py", 1), ("d", "symbol", "run", "src/d.py", None), ("e", "symbol", "go", "tests/e.py", 1), ("f", "symbol", "go", None, 1)]
    n = spark.createDataFrame(rows, "id string, kind string, name string, file string, line long")
    e = edges(spark, [(x, y, "uses", "EXTRACTED", "f", 1, 1) for x in "abcdef" for y in "abcdef" if x < y])
    assert [r["id"] for r in G.god_nodes(n, e).collect()] == ["a"]


def test_overloads_are_plain_then_by_arity_then_by_line(spark):
    rows = [("1", "method", "f", "x", 1, 2), ("2", "method", "f", "x", 5, 2), ("3", "method", "f", "x", 9, 2), ("4", "method", "f", "x", 12, None), ("5", "class", "f", "x", 20, None), ("6", "method", "f", "y", 3, 0)]
    n = spark.createDataFrame(rows, "id string, kind string, file string, name string, line long, arity int")
    got = {r["id"]: r["qualified"] for r in G.number_overloads(n).collect()}
    assert got == {"1": "symbol:f:x", "2": "symbol:f:x/2", "3": "symbol:f:x/2@9", "4": "symbol:f:x/12", "5": None, "6": "symbol:f:y"}


def test_ambiguity_queue_has_reviewed_edges_and_decisions(spark):
    e = edges(spark, [("a", "b", "uses", "ambiguous", "f", 1, 2), ("a", "c", "uses", "REVIEWED", None, 0, 2), ("a", "d", "uses", "EXTRACTED", "f", 1, 1)])
    key = hashlib.sha256(b"a\0c\0uses\0\0").hexdigest()[:20]
    got = {r["target"]: (r["review_key"], r["decision"]) for r in G.ambiguity_queue(e, spark.createDataFrame([(key, "accepted")], "review_key string, decision string")).collect()}
    assert got == {"b": (hashlib.sha256(b"a\0b\0uses\0f\x001").hexdigest()[:20], None), "c": (key, "accepted")}


def test_risk_of_a_change(spark):
    files = spark.createDataFrame([("src/a.py",), ("src/b",), ("README.MD",)], "path string")
    symbols = spark.createDataFrame([("a", True), ("b", False)], "id string, signature boolean")
    hit = spark.createDataFrame([(1, "uses")] * 3 + [(2, "uses")] * 4 + [(1, "contains")] * 17, "hop int, label string")
    r = I.risk_score(files, symbols, hit).first()
    assert (r["code_files"], r["doc_files"], r["direct"], r["transitive"], r["containment"]) == (2, 1, 3, 4, 17) and r["score"] == 10 + 2 + 12 + 9 + 4 + 2 and r["level"] == "medium"
    none = I.risk_score(files.limit(0), symbols.limit(0), hit.limit(0)).first()
    assert none["score"] == 0 and none["level"] == "low"


def test_diffs_and_spread(spark):
    text = ["diff --git", "--- a/x.py", "+++ b/x.py", "@@ -1 +3 @@", "+def f(a):", "@@ -9,2 +8,0 @@", "-gone", "@@ -20,0 +18,3 @@ f", "+++ b/d.MD", "@@ -1 +1 @@", "+words"]
    files = {r["file"]: r for r in P.diff_files(spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "diff int, no int, line string")).collect()}
    assert [tuple(x) for x in files["x.py"]["ranges"]] == [(3, 3), (18, 20)] and files["x.py"]["types"] == ["signature"] and files["d.MD"]["types"] == ["documentation"]
    e = edges(spark, [("user", "f", "uses", "EXTRACTED", "f", 1, 1), ("f", "used", "uses", "EXTRACTED", "f", 1, 1), ("box", "f", "contains", "EXTRACTED", "f", 1, 1), ("f", "inner", "contains", "EXTRACTED", "f", 1, 1), ("far", "user", "uses", "EXTRACTED", "f", 1, 1)])
    seeds = spark.createDataFrame([("f", False)], "id string, signature boolean")
    assert P.depth(seeds) == 2 and P.depth(seeds.withColumn("signature", F.lit(True))) == 3
    assert sorted((r["id"], r["hop"]) for r in P.spread(e, seeds, 2).collect()) == [("far", 2), ("inner", 1), ("user", 1)]


def test_concept_search_scores(spark):
    n = spark.createDataFrame([("1", "red ring", "box"), ("2", "ring", "box"), ("3", "blue", "red box"), ("4", "blue", "box")], "id string, name string, container string")
    e = edges(spark, [("2", str(k), "uses", "EXTRACTED", "f", 1, 1) for k in range(10, 25)])
    assert [(r["id"], r["score"]) for r in I.concept_search(n, e, " Red RING of ").collect()] == [("2", 50), ("1", 20), ("3", 10)]
    assert [(r["id"], r["score"]) for r in I.concept_search(n, e, "red ring").collect()] == [("1", 120), ("2", 50), ("3", 10)] and I.concept_search(n, e, "of").count() == 0
