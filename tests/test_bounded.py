"""Bounded results and resolution beyond names, on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import bounded as B
from loamgraph.operators import resolve as V
from loamgraph.operators import session as O


def test_comments_belong_to_the_next_declaration_in_scope(spark):
    symbols = spark.createDataFrame([("f", "outer", 1, 30), ("f", "inner", 10, 14), ("f", "after", 33, 40), ("f", "next", 20, 22)], "file string, id string, start int, end int")
    comments = spark.createDataFrame([(1, "f", 5, 5), (2, "f", 18, 18), (3, "f", 12, 12), (4, "f", 29, 30), (5, "f", 50, 50), (6, "g", 1, 1)], "comment_id int, file string, line int, end_line int")
    assert {r["comment_id"]: r["owner"] for r in V.comment_owners(comments, symbols).collect()} == {1: "outer", 2: "next", 3: "inner", 4: "outer", 5: None, 6: None}


def test_text_hits_lie_in_symbols_that_have_not_ended(spark):
    symbols = spark.createDataFrame([("f", "a", 1, 20), ("f", "b", 5, 5), ("f", "c", 30, None), ("g", "d", 4, 6)], "file string, id string, start int, end int")
    points = spark.createDataFrame([(1, "f", 6), (2, "f", 5), (3, "f", 25), (4, "f", 99), (5, "g", 1), (6, "g", 9)], "point_id int, file string, line int")
    assert {r["point_id"]: (r["id"], r["inside"]) for r in V.holding(points, symbols).collect()} == {1: ("a", True), 2: ("b", True), 3: ("b", False), 4: ("c", True), 5: (None, False), 6: ("d", False)}


def test_imports_local_definitions_and_neither(spark):
    c = spark.createDataFrame([(1, "f", "x", "m1", "f"), (1, "f", "y", "m2", "g"), (2, "f", "x", "m1", "h"), (2, "f", "y", "m2", "g"), (3, "f", "x", "m1", "h"), (3, "f", "y", "m2", "g")], "call_id int, file string, id string, module string, target_file string")
    i = spark.createDataFrame([(1, "m2"), (2, "m2"), (2, "m2"), (3, "other")], "call_id int, module string")
    assert sorted((r["call_id"], r["id"]) for r in V.import_filter(c, i).collect()) == [(1, "x"), (2, "y"), (3, "x"), (3, "y")]


def test_inheritance_overrides_and_routes(spark):
    symbols = spark.createDataFrame([("1", "Base", "interface", "f"), ("2", "Base", "class", "g"), ("3", "Kid", "class", "f"), *[(f"m{k}", "Many", "class", "z") for k in range(5)]], "id string, name string, kind string, file string")
    bases = spark.createDataFrame([("3", "a::Base", "f"), ("3", "Many", "f"), ("9", "Base", "h"), ("2", "Base", "q")], "child string, written string, file string")
    got = sorted((r["source"], r["target"], r["label"], r["confidence"]) for r in V.inheritance(bases, symbols).collect())
    assert got == [("2", "1", "implements", "INFERRED"), ("3", "1", "implements", "EXTRACTED"), ("9", "1", "implements", "AMBIGUOUS"), ("9", "2", "inherits", "AMBIGUOUS")]
    methods = spark.createDataFrame([("a", "A", "f", 1), ("b", "B", "f", 1), ("b2", "B", "f", 2), ("c", "C", "f", 2), ("d", "C", "g", None)], "id string, type string, name string, arity int")
    closure = spark.createDataFrame([("C", "B", 1), ("C", "A", 2), ("B", "A", 1)], "id string, ancestor string, level int")
    assert sorted((r["source"], r["target"]) for r in V.overrides(methods, closure).collect()) == [("b", "a"), ("c", "b2")]
    calls = spark.createDataFrame([(1, "show", "Users"), (2, "show", "page.php"), (3, "show", "x"), (4, "none", "x")], "route_id int, name string, container string")
    targets = spark.createDataFrame([("9", "show", "users", "a/b"), ("8", "show", "other", "a/Page.php"), ("7", "show", "other", "c")], "id string, name string, container string, file string")
    assert sorted((r["route_id"], r["id"], r["preference"]) for r in V.routes(calls, targets).collect()) == [(1, "9", 0), (2, "8", 1), (3, "7", 2)]


def test_include_scope_and_reach(spark):
    rules = ["src/*core*", "docs/a.md"]
    paths = spark.createDataFrame([("src/my-core/x.py",), ("src/other/core/x.py",), ("lib/src/core/x",), ("docs/a.md",), ("docs/a.mdx",)], "p string")
    assert [r[0] for r in paths.select(V.include_scope(F.col("p"), rules)).collect()] == [True, False, False, True, False]
    assert V.reaches("src", rules) and V.reaches("", rules) and V.reaches("src/core/deep", rules) and not V.reaches("src/other", rules) and not V.reaches("lib", rules) and V.reaches("lib", [])
    assert all(r[0] for r in paths.select(V.include_scope(F.col("p"), [])).collect())


def test_units_revisions_and_members(spark):
    files = spark.createDataFrame([("a/b/c/x.cs",), ("a/y.cs",), ("z.cs",)], "path string")
    units = spark.createDataFrame([("a", "A"), ("a/b", "B")], "folder string, unit string")
    assert {r["path"]: r["unit"] for r in V.nearest_unit(files, units).collect()} == {"a/b/c/x.cs": "B", "a/y.cs": "A"}
    m = spark.createDataFrame([(1, "h", "main", False), (2, "p", "dev", False), (3, "q", None, False), (4, None, "", True)], "id int, commit string, branch string, stale boolean")
    got = {r["id"]: (r["relation"], r["branch_mismatch"], r["stale"]) for r in V.revision_status(m, spark.createDataFrame([("p",)], "commit string"), "h", "main").collect()}
    assert got == {1: ("current", False, False), 2: ("ancestor", True, False), 3: ("diverged", False, True), 4: ("unknown", False, True)}


def test_bounded_views(spark):
    nodes = spark.createDataFrame([(str(i), "k", f"n{i}") for i in range(10)], "id string, kind string, name string")
    edges = spark.createDataFrame([(str(i), str(j), "uses") for i in range(10) for j in range(10) if i != j], "source string, target string, label string")
    assert tuple(B.bounded(nodes, edges, ["id"], 4).first()) == (4, 6, 8, 4) and tuple(B.bounded(nodes.limit(0), edges, ["id"], 4).first()) == (0, 0, 0, 0)
    rows = [(r["id"], r["next_offset"]) for r in B.page_with_next(nodes, ["id"], 6, 3).collect()]
    assert rows == [("6", 9), ("7", 9), ("8", 9)] and [r["next_offset"] for r in B.page_with_next(nodes, ["id"], 7, 3).collect()] == [None] * 3
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, name string")
    assert [r["id"] for r in B.one_per_name(names, "name", ["id"], 3).orderBy("place").collect()] == [1, 3, 2]
    top = spark.createDataFrame([("1", 9), ("2", 8)], "id string, degree long")
    kept, links = B.map_view(nodes, edges, top, F.when(F.col("id") == "1", F.lit("7")), 2)
    assert sorted(r["id"] for r in kept.collect()) == ["1", "2", "7"] and links.count() == 6


@pytest.mark.parametrize(("text", "origin", "evaluation", "want"), [("<environment_context> x", None, None, True), ("<instructions> AGENTS.md", "", None, True), ("<instructions> x", None, False, False), ("x", "bootstrap", None, True), ("<environment_context>", "conversation", None, False), ("x", None, True, True), ("Consulta la MEMORIA compartida de loamgraph", None, None, True), ("shared memory", None, None, False), ("shared memory: message_id 3", None, None, True), (None, None, None, False)])
def test_injected_context(spark, text, origin, evaluation, want):
    df = spark.createDataFrame([(text, origin, evaluation)], "t string, o string, e boolean")
    assert df.select(B.injected_context(F.col("t"), F.col("o"), F.col("e"))).first()[0] is want


def test_topics_owners_and_stores(spark):
    t = spark.createDataFrame([("x",), ("y",), ("z",)], "topic string")
    e = spark.createDataFrame([("x", "A"), ("x", "b"), ("y", "a"), ("z", None)], "topic string, agent string")
    ids = lambda *a: sorted(r["topic"] for r in B.visible_topics(t, e, *a).collect())
    assert ids(["a"], True) == ["y"] and ids(["a", "B"], True) == ["x", "y"] and ids([], True) == [] and ids(None, True) == ids(["a"], False) == ["x", "y", "z"]
    a, b = spark.createDataFrame([(1, "p"), (2, "p")], "id int, v string"), spark.createDataFrame([(2, "s"), (3, "s"), (3, "s")], "id int, v string")
    assert sorted(tuple(r) for r in B.merge_store(a, b).collect()) == [(1, "p"), (2, "p"), (3, "s")]


def test_tools_and_proposals(spark):
    rows = [("Read", None, "read"), ("Bash", "cd a && rg x | cat", "search"), ("Bash", "make; head f", "read"), ("Bash", "make", None), ("Task", "rg", None), ("MultiEdit", "", "edit"), ("Bash", None, None)]
    df = spark.createDataFrame(rows, "name string, command string, want string")
    assert all(r[0] == r[1] for r in df.select(O.classify_tool(F.col("name"), F.col("command")), "want").collect())
    m = spark.createDataFrame([(1, k, "assistant", f"we fixed {k}") for k in range(8)] + [(1, 9, "user", "use it"), (1, 10, "assistant", "ok."), (2, 1, "assistant", "gracias"), (3, 1, "tool", None)], "session int, seq int, role string, content string")
    (r,) = O.proposals(m).collect()
    assert r["session"] == 1 and r["messages"] == 6 and r["content"].split("\n")[0] == "assistant: we fixed 2"
