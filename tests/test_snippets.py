"""Snippets against all choices of windows."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from loamgraph.operators import snippets as S

TERMS = ["alpha", "Beta", "gamma", "delta", "eps", "zeta"]


def plain(text, budget, most=3):
    low = (text or "").lower()
    merged = []
    for at, t in sorted((low.find(t.lower()), t) for t in TERMS if t.lower() in low):
        start, stop = max(0, at - S.BEFORE), min(len(low), at + S.AFTER)
        if merged and start <= merged[-1][1] + S.GAP:
            merged[-1][1] = max(merged[-1][1], stop)
            merged[-1][2].append(at)
        else:
            merged.append([start, stop, [at]])
    cut = [(a, min(b, a + budget), sum(x < min(b, a + budget) for x in at)) for a, b, at in merged]
    sets = [c for n in range(most + 1) for c in combinations(cut, n) if sum(b - a for a, b, _ in c) <= budget]
    best = min(sets, key=lambda c: (-sum(x[2] for x in c), sum(b - a for a, b, _ in c), [x[:2] for x in c]))
    return [(a, b) for a, b, _ in best] or [(0, min(len(low), S.AFTER))]


def test_best_spans_equal_all_choices(spark):
    r = random.Random(9)
    texts = [None, "", "nothing", "alpha"] + ["".join(r.choice([*TERMS, *(["x" * r.randint(1, 300)] * 8)]) + " " for _ in range(r.randint(1, 25))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for budget in (250, 640, 900):
        spans = S.best_spans(F.col("text"), TERMS, budget)
        for x in df.select("id", spans.alias("s"), S.snippet(F.col("text"), spans).alias("told")).collect():
            assert [(s["start"], s["stop"]) for s in x["s"]] == plain(texts[x["id"]], budget), (x["id"], budget)
            assert all((texts[x["id"]] or "")[s["start"] : s["stop"]] in x["told"] for s in x["s"])
