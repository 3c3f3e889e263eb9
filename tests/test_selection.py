"""Running sums, budgeted contexts and covers against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loamgraph.operators import selection as S


def test_running_sum(spark):
    r = random.Random(2)
    rows = [(i, r.randint(0, 9), r.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, v long").repartition(7)
    got = {x["id"]: x["running"] for x in S.running_sum(df, [F.desc("k"), F.asc("id")], F.col("v")).collect()}
    total, want = 0, {}
    for i, _, v in sorted(rows, key=lambda x: (-x[1], x[0])):
        total += v
        want[i] = total
    assert got == want and S.running_sum(df.limit(0), [F.asc("id")], F.col("v")).count() == 0


def plain_context(items, budget, envelope=20):
    lists = {}
    for name, rank, i, cost in sorted(items, key=lambda x: x[1]):
        lists.setdefault(name, []).append((name, rank, i, cost))
    over = lambda: sum(x[3] for v in lists.values() for x in v) + envelope > budget
    for name in S.TRIMMED:
        while lists.get(name) and over():
            lists[name].pop()
    for name in ("topics", "memories"):
        while len(lists.get(name, ())) > 1 and over():
            lists[name].pop()
    for name in ("memories", "topics"):
        if lists.get(name) and over():
            lists[name].clear()
    return {x for v in lists.values() for x in v}


def test_budgeted_context(spark):
    r = random.Random(4)
    rows, want = [], set()
    for request in range(40):
        items = [(name, rank, f"{name}{rank}", r.randint(1, 60)) for name in ("topics", "memories", *S.TRIMMED) for rank in range(1, r.randint(1, 6))]
        rows += [(request, *x) for x in items]
        want |= {(request, *x) for x in plain_context(items, 300)}
    df = spark.createDataFrame(rows, "request long, list string, rank long, id string, cost long")
    got = {(x["request"], x["list"], x["rank"], x["id"], x["cost"]) for x in S.budgeted_context(df, 300).collect()}
    assert got == want
    assert S.budgeted_context(df.limit(0), 300).count() == 0


def plain_cover(rows):
    score, concerns = {}, {}
    for c, k, s in rows:
        score[c] = max(s, score.get(c, s))
        concerns.setdefault(c, set()).add(k)
    left, out = set().union(*concerns.values()) if concerns else set(), []
    while left:
        best = min(concerns, key=lambda c: (-len(concerns[c] & left), -score[c], c))
        out.append((best, len(concerns[best] & left)))
        left -= concerns[best]
    return out


def test_cover_equals_one_at_a_time(spark):
    r = random.Random(6)
    for n, m in ((12, 9), (60, 40)):
        rows = [(f"c{r.randint(0, n)}", r.randint(0, m), float(r.randint(0, 2))) for _ in range(4 * n)]
        df = spark.createDataFrame([*rows, (None, 1, 1.0), ("x", None, 1.0)], "candidate string, concern long, score double")
        assert [(x["candidate"], x["gain"]) for x in S.greedy_cover(df).orderBy("turn").collect()] == plain_cover(rows)
    assert S.greedy_cover(df.limit(0)).count() == 0


def test_capped_greedy_equals_the_fold(spark):
    r = random.Random(11)
    rows = [(i, f"s{r.randint(0, 12)}", r.choice(["a", "b", "c", "d", None]), r.randint(0, 30)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, source string, kind string, rank long")
    for caps in ({"source": 2, "kind": 3}, {"source": 1, "kind": 40}, {"source": 5}):
        used, want = {}, []
        for x in sorted(rows, key=lambda x: (x[3], x[0])):
            keys = [(c, x[1] if c == "source" else x[2]) for c in caps]
            if all(used.get(k, 0) < caps[k[0]] for k in keys):
                want.append(x[0])
                for k in keys:
                    used[k] = used.get(k, 0) + 1
        assert sorted(x["id"] for x in S.capped_greedy(df, ["rank", "id"], caps).collect()) == sorted(want)
        assert [x["id"] for x in S.capped_greedy(df, ["rank", "id"], caps, 4).orderBy("rank", "id").collect()] == want[:4]
    assert S.capped_greedy(df.limit(0), ["rank", "id"], {"source": 2}).count() == 0


def test_flow_list(spark):
    nodes = spark.createDataFrame([("a", "A", "src/a.py"), ("b", "B", "src/b.py"), ("t", "T", "tests/t.py"), ("c", "C", None)], "id string, name string, file string")
    rows = [("t", "a", "llama", "EXTRACTED", "x", 1), ("a", "b", "llama", "AMBIGUOUS", "src/a.py", 5), ("a", "c", "llama", "EXTRACTED", "src/a.py", 7), ("a", "c", "llama", "EXTRACTED", "src/a.py", 6), ("a", "b", "crea", "EXTRACTED", None, None)]
    rows += [("b", "c", "llama", "EXTRACTED", "src/b.py", 1), ("b", "a", "llama", "EXTRACTED", "src/b.py", 2), ("c", "a", "contiene", "EXTRACTED", "z", 1), ("b", "x", "llama", "EXTRACTED", "z", 1)]
    edges = spark.createDataFrame(rows, "source string, target string, label string, confidence string, file string, line long")
    got = [tuple(x) for x in S.flow_list(nodes, edges).orderBy("place").collect()]
    assert got == [(1, "A", "llama", "C", "EXTRACTED", "src/a.py:6"), (2, "B", "llama", "A", "EXTRACTED", "src/b.py:2"), (3, "B", "llama", "C", "EXTRACTED", "src/b.py:1"), (4, "A", "crea", "B", "EXTRACTED", None)]
