"""Filter audit, exact search and importance resampling against plain versions, on nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import filter_audit, importance, va_file

DOCS = "doc_id long, text string, lang string, part string, digest string, n long, row long, label int, bucket int, weight long"
LONG = " ".join(f"word{i % 977}x" for i in range(30_000))
ROWS = [
    (1, "Same text % here", "en"), (2, "Same text % here", "de"), (2, "Same text % here", "de"), (3, None, None), (4, "", "en"), (5, " \t\n ", ""), (None, "Same text % here", "en"), (None, "", "en"), (6, LONG, "en"),
    (7, LONG, "en"), (8, "THE CAT " * 150, "fr"), (9, "ÉCOLE ß 日本 🙂 ÀÉ", "fr"), (10, "a b c d e " * 60, "en"), (-3, "the cat sat on the mat and then it ran off over the hill to see what else it could find there", "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, None, None), (6, 1, 1), (7, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1), (-3, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "p", "d", 5, 6, 7, 8, 9) for i, t, g in ROWS], DOCS)


def plain_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = defaultdict(lambda: dict.fromkeys(filter_audit.FIGURES, 0))
    for d, t, g in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[g or "", order, step]
                c["removed"] += not gone and fails[f]
                c["redundant"] += gone and fails[f]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += not gone and fails[f] and d in good
                c["toxic_lost"] += not gone and fails[f] and d in toxic
                gone = gone or fails[f]
                c["kept"] += not gone
    total = Counter()
    for (part, order, step), c in out.items():
        total[part, order[step - 1]] += c["removed"]
    for (part, order, step), c in out.items():
        c["shapley"] = total[part, order[step - 1]]
    return dict(out)


def test_audit(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.failing_sets(docs, labels)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): {f: r[f] for f in filter_audit.FIGURES} for r in got} == plain_audit(ROWS, LABELS) and len(got) == 4 * 600
    assert filter_audit.audit(filter_audit.failing_sets(docs.limit(0), labels)).count() == 0
    assert filter_audit.audit(filter_audit.failing_sets(docs, labels.limit(0))).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_many_parts_and_one_hot_text(spark):
    rows = [(i, "same words", f"l{i % 700}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = filter_audit.audit(filter_audit.failing_sets(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    e = got.where("filter_order = 'EABCD' and step = 1").agg(F.sum("removed"), F.count("*")).first()
    assert tuple(e) == (2999, 700)


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all()
    for s in range(32):
        for o, order in enumerate(filter_audit.ORDERS):
            assert table[s, o] == next((k for k, f in enumerate(order) if s >> "ABCDE".index(f) & 1), 5)


def plain_search(rows, asked, k):
    whole = lambda v: None if v is None or any(x is None or not math.isfinite(x) for x in v) else tuple(math.floor(256 * x) for x in v)
    have = {(i, whole(v)) for i, v in rows if whole(v) is not None}
    out = []
    for q, v in {(i, whole(v)) for i, v in asked if i is not None and whole(v) is not None}:
        found = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i is None, i or 0, i) for i, x in have if len(x) == len(v) and (i, x) != (q, v))
        out += [(q, rank, i, -s) for rank, (s, _, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells,first,block", [(64, None, 10_000), (2, 1, 3), (4, 2, 7)])
def test_search(spark, cells, first, block):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(2000 + i, [0.5 + i / 4096] * 8) for i in range(40)]  # copies and ties after flooring
    rows += [(50, rows[50][1]), (50, rows[50][1]), (50, [1.0] * 8), (None, rows[100][1]), (3000, None), (3050, [1.0, None] * 4), (3100, [float("nan")] * 8), (3150, [float("inf")] * 8), (-50, [1e6] + [0.0] * 7), (4000, []), (4050, []), (4100, [1.0, 2.0]), (4150, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, vector array<double>, rank string, row int")
    got = va_file.search(df, df.where("id % 50 = 0"), k=5, cells=cells, first=first, block=block, sample=100).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(rows, [x for x in rows if x[0] is not None and x[0] % 50 == 0], 5)


def test_search_of_new_vectors_and_empty_tables(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, vector array<float>")
    asked = spark.createDataFrame([(7, [3.5, -1.0]), (8, [-2.0, 0.25])], "id long, vector array<float>")
    got = sorted(map(tuple, va_file.search(df, asked, k=3).collect()))
    assert got == plain_search([(i, [float(i), 1.0]) for i in range(9)], [(7, [3.5, -1.0]), (8, [-2.0, 0.25])], 3)
    assert va_file.search(df.limit(0), asked).count() == 0 and va_file.search(df, asked.limit(0)).count() == 0
    big = spark.createDataFrame([(i, [float(i) * 2.0**54]) for i in range(4)], "id long, vector array<double>")
    assert [r["score"] for r in va_file.search(big, big.where("id = 1"), k=2).orderBy("rank").collect()][0] in (0, None)


def plain_resample(rows, target, percent=25, least=20):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return w, [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for d, text in rows:
        w, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    fit = sorted((-x[3], x[0] is None, x[0] or 0, k) for k, x in enumerate(out) if x[4])
    rank = {k: place for place, (_, _, _, k) in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((*x[:4], rank.get(k)) for k, x in enumerate(out)), key=str)


def test_resample(spark, docs):
    target = spark.createDataFrame([("the cat sat on the mat", 1), (None, 2), ("", 3)], "text string, doc_id long")
    more = [(100 + i, f"the cat number {i} " + " ".join(f"w{i * j % 37}" for j in range(i % 40))) for i in range(200)]
    rows = [(d, t) for d, t, _ in ROWS] + more
    df = docs.select("doc_id", "text", "bucket", "weight").unionByName(spark.createDataFrame([(d, t, 1, 2) for d, t in more], "doc_id long, text string, bucket int, weight long"))
    assert sorted(map(tuple, importance.resample(df, target).collect()), key=str) == plain_resample(rows, ["the cat sat on the mat", None, ""])
    assert sorted(map(tuple, importance.resample(df, target.limit(0)).collect()), key=str) == plain_resample(rows, [])
    assert importance.resample(df.limit(0), target).count() == 0
