"""Operators at sizes and on shapes where they used to make too many rows, against plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
from pyspark.sql import functions as F

from loamgraph.operators import bounded as B
from loamgraph.operators import graph as G
from loamgraph.operators import retrieval as R
from loamgraph.operators import selection as S
from loamgraph.operators import session as O
from loamgraph.operators import source as Src
from loamgraph.operators import traverse as T
from loamgraph.plans import graph_queries as Q
from loamgraph.plans import intent as I
from loamgraph.sources import model as M
from tests.conftest import SF


def test_related_pairs_are_counted_in_blocks_without_a_row_a_pair_and_term(spark):
    rng = random.Random(3)
    docs = {rng.randrange(10**6) - 500: {f"t{rng.randrange(40)}" for _ in range(rng.randrange(9))} for _ in range(120)}
    df = Counter(t for ts in docs.values() for t in ts)
    want = {}
    for a, b in combinations(sorted(docs), 2):
        n = sum(2 <= df[t] <= 25 for t in docs[a] & docs[b])
        if n >= 2:
            want[a, b] = n
    posts = spark.createDataFrame([(d, t) for d, ts in docs.items() for t in ts], "doc long, term string")
    for block in (10_000, 60):
        out = R.related_pairs(posts, 2, 25, block)
        assert {(r["a"], r["b"]): r["shared"] for r in out.collect()} == want and want
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroups")[0]
    names = posts.selectExpr("concat('d', doc) as doc", "term")
    assert {(r["a"], r["b"], r["shared"]) for r in R.related_pairs(names, 2, 25, 60).collect()} == {(*sorted((f"d{a}", f"d{b}")), n) for (a, b), n in want.items()}


def test_lists_of_terms_are_not_shuffled_but_for_documents_given_twice(spark):
    docs = spark.createDataFrame([(1, "apple pear fig"), (2, "pear apple plum"), (1, "plum apple"), (3, None), (None, "apple fig"), (None, "fig apple")], "doc long, text string")
    lists = R.term_lists(docs)
    assert sorted(((r["doc"], r["terms"]) for r in lists.collect()), key=str) == sorted([(1, ["apple", "fig", "pear", "plum"]), (2, ["apple", "pear", "plum"]), (3, []), (None, ["apple", "fig"])], key=str)
    assert {tuple(r) for r in R.related_lists(lists, 2, 3).collect()} == {(1, 2, 3)}  # the two rows without an id count once, so apple is in three
    once = R.term_lists(spark.range(50).selectExpr("id as doc", "'apple pear' as text"))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # that of documents given twice


def test_first_alike_meets_the_first_ids_of_a_key_alone(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(300) if rng.random() < 0.98 else None, rng.choice(["a", "b", "c", None])) for _ in range(600)]
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    data, queries = spark.createDataFrame(rows, "id long, label string"), spark.createDataFrame(asked, "query_id long, label string")
    got = R.first_alike(data, queries, "label", 4)
    want = set()
    for q in {i for i, _ in asked}:
        ids = sorted(i for x, lab in asked if x == q and lab for i, other in rows if other == lab and i is not None and i != q)[:4]
        want |= {(q, i, k) for k, i in enumerate(ids, 1)}
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want and want
    many = R.first_alike(spark.range(200_000).selectExpr("id", "'x' as label"), spark.range(200_000).selectExpr("id as query_id", "'x' as label"), "label", 3)
    assert many.count() == 600_000  # all pairs would be 40 thousand million


def test_scores_of_a_document_are_summed_where_its_postings_are(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i % 3} alpha") for i in range(200)], "doc long, text string")
    queries = spark.createDataFrame([(i, f"beta{i} gamma1 alpha") for i in range(7)], "query_id long, text string")
    out = R.bm25(docs, queries, limit=3)
    assert out.count() == 21
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc", out._jdf.queryExecution().executedPlan().toString())


def test_an_item_of_few_rare_words_is_found_in_whole(spark):
    items = spark.createDataFrame([(1, "a the b"), (2, "x rare the y"), (3, "a the")], "query_id long, text string")
    docs = spark.createDataFrame([(1, "za the bz"), (2, "x rare the yes"), (3, "the rare x y"), (4, "a the\tb"), (5, None)], "doc long, text string")
    assert sorted(tuple(r) for r in R.containing(docs, items).collect()) == [(1, 1), (2, 2), (3, 1), (3, 4)]


def test_offers_are_shuffled_once_and_not_counted_where_no_one_asks(spark):
    edges = M.edges(spark, SF).select("source", "target")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan and len(re.findall(r"hashpartitioning\(l_partkey", plan.split("Initial Plan")[0])) == 1


def test_reach_without_reasons_does_not_sort(spark):
    view = spark.createDataFrame([("a", "b", "x", None), ("b", "c", "x", "E"), ("a", "c", "y", "E"), ("c", "a", "x", "E"), ("c", "d", "x", "E")], "at string, to string, label string, confidence string")
    seeds = spark.createDataFrame([("a",), ("a",)], "id string")
    for depth in (1, 2, 5):
        assert sorted(map(tuple, T.reach(view, seeds, depth).collect())) == sorted(map(tuple, T.hops(view, seeds, depth).select("id", "hop").collect()))


def test_flows_are_chosen_past_parallel_edges_and_full_sources(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"name{i % 4}", "src/f", 1) for i in range(12)], "id string, name string, file string, line long")
    rows = [(f"n{s}", f"n{t}", lab, "EXTRACTED", None, None) for s in range(12) for t in range(12) if s != t for lab in ("u", "v") for _ in range(3)]
    got = S.flow_list(nodes, spark.createDataFrame(rows, "source string, target string, label string, confidence string, file string, line long"), ("u", "v"), 6).collect()
    assert [r["relation"] for r in got] == ["u"] * 3 + ["v"] * 3 and len({(r["source"], r["relation"], r["target"]) for r in got}) == 6
    assert max(Counter(r["source"] for r in got).values()) == 2


def test_edges_of_a_round_are_dealt_by_id_before_the_least_is_sought(spark):
    rng = random.Random(7)
    rows = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice("xy"), rng.choice(["E", None])) for _ in range(300)]
    view, seeds = spark.createDataFrame(rows, "at string, to string, label string, confidence string"), spark.createDataFrame([("n1",), ("n1",), ("n2",)], "id string")
    seen, frontier, want = {"n1", "n2"}, {"n1", "n2"}, set()
    for k in (1, 2):
        met = {}
        for at, to, label, confidence in rows:
            if at in frontier and to not in seen:
                met.setdefault(to, []).append((at, label, confidence or ""))
        want |= {(i, k, *min(es)) for i, es in met.items()}
        frontier, seen = set(met), seen | set(met)
    out = T.hops(view, seeds, 2).where("hop > 0").fillna("", ["confidence"])
    assert {tuple(r) for r in out.collect()} == want and want
    plans = []
    made, T.written = T.written, lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or made(df, what)
    try:
        T.hops(view, seeds, 1)
    finally:
        T.written = made
    lines = plans[-1].splitlines()
    assert max(i for i, x in enumerate(lines) if "SortAggregate" in x) < min(i for i, x in enumerate(lines) if "Exchange hashpartitioning(id" in x)


def test_offers_keep_their_partitions_apart(spark):
    plan = M.edges(spark, SF).select("source", "target")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(l_partkey#\d+L?, 4\), REPARTITION_BY_NUM", plan)


def test_first_neighbors_are_ranked_in_one_shuffle(spark):
    rng = random.Random(9)
    rows = [(f"n{rng.randrange(12)}", rng.choice([f"n{rng.randrange(12)}", None])) for _ in range(300)]
    near = {}
    for a, b in rows:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = O.first_neighbors(spark.createDataFrame(rows, "source string, target string"), 3)
    assert sorted(map(tuple, out.collect())) == sorted((i, o, k) for i, os in near.items() for k, o in enumerate(sorted(os)[:3], 1))
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ") == 1


def test_only_files_of_the_first_hits_are_cut_into_lines(spark):
    texts = [(9, "a b"), (7, "x.y\nnone\nx.y"), (5, "xzy x"), (3, "_b b1\n(b)\r\nb"), (2, None), (1, ""), (7, "x.y b"), (8, "b\nb"), (4, "$1"), (6, "a$1\n b\n")]
    files = spark.createDataFrame(texts, "file long, text string")
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("file", (F.col("i") + 1).cast("long").alias("line"), "text")
    for most in (1, 2, 3, 9):
        got = B.identifier_hits_in(files, ["x.y", "b", "$1", "q"], most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, B.identifier_hits(lines, ["x.y", "b", "$1", "q"], most).collect()))
    split = []
    made, B.identifier_hits = B.identifier_hits, lambda lines, *a: split.append({r["file"] for r in lines.select("file").collect()}) or made(lines, *a)
    try:
        B.identifier_hits_in(files, ["b"], 1)
    finally:
        B.identifier_hits = made
    assert split == [{3}]


def test_feature_vectors_hash_a_feature_once(spark, monkeypatch):
    rng = random.Random(11)
    docs = [[rng.choice(["aa", "bb", "cc", "é_"]) for _ in range(rng.choice([0, 1, 2, 40, 400]))] for _ in range(60)] + [["aa"] * 160, [f"w{i}" for i in range(640)]]

    def plain(ts):
        v = [0.0] * 16
        for f in [*ts, *(f"{a} {b}" for a, b in zip(ts, ts[1:], strict=False))]:
            h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            v[h % 16] += 1.0 if h & 1 else -1.0
        n = sum(x * x for x in v) ** 0.5
        return [round(x / n, 6) if n else 0.0 for x in v]

    df = spark.createDataFrame(list(enumerate(docs)), "id long, ts array<string>").repartition(2)
    got = {r["id"]: r["v"] for r in df.select("id", Src.feature_vector(F.col("ts"), 16).alias("v")).collect()}
    assert got == {i: plain(ts) for i, ts in enumerate(docs)}
    calls, hashed = [], hashlib.blake2b
    monkeypatch.setattr(Src.hashlib, "blake2b", lambda *a, **k: calls.append(a) or hashed(*a, **k))
    Src._vectors(pa.array([["aa", "bb"] * 50, [], ["bb", "aa"]]), 16)
    assert len(calls) == 4


def test_dangling_ends_are_counted_without_a_shuffle_of_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    rows = [("a", "b"), ("a", "x"), ("x", "a"), ("x", "y"), ("x", "y"), ("x", "x"), (None, "a"), (None, None), ("y", None)]
    edges = spark.createDataFrame([(s, t, "f", 1, "E") for s, t in rows] + [("a", "b", None, 1, "AMBIGUOUS")], "source string, target string, file string, line long, confidence string")
    assert tuple(I.validate_package(nodes, edges).first()) == (10, 8, 1, 1)
    known = edges.where("source = 'a' and target = 'b'")
    assert tuple(I.validate_package(nodes, known).first()) == (2, 0, 1, 1) and tuple(I.validate_package(nodes, edges.limit(0)).first()) == (0, 0, 0, 0)
    assert not re.search("Join", I.validate_package(nodes, edges)._jdf.queryExecution().executedPlan().toString())


def test_heavy_pairs_are_counted_once_for_all_who_read_them(spark):
    pairs = Q._heavy_pairs(spark, SF)
    assert pairs.count() > 0 and not re.search("Join|Aggregate", pairs._jdf.queryExecution().executedPlan().toString())


def test_definitions_of_hubs_are_counted_in_the_shuffle_by_name(spark):
    nodes = spark.createDataFrame([("a", "k", "x", "src/f", 1), ("b", "k", "x", "tests/f", 2), ("c", "k", "y", "src/f", 0), ("d", "k", None, "src/f", 4), ("e", "k", "z", "src/f", 5)] + [(f"h{i}", "k", "w", "src/f", 6) for i in range(3)], "id string, kind string, name string, file string, line long")
    edges = spark.createDataFrame([(s, t, "u") for s in "abcde" for t in ("h0", "h1", "h2", "a")], "source string, target string, label string")
    out = G.god_nodes(nodes, edges)
    assert [(r["id"], r["degree"]) for r in out.collect()] == [("a", 9), ("e", 4)]
    assert "Semi" not in out._jdf.queryExecution().optimizedPlan().toString()
