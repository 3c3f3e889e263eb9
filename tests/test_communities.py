"""Communities by modularity, against a plain sequential version on three graphs."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import pytest

from loamgraph.operators import communities as C

#: The karate club's friendships (Zachary 1977). Fixed values.
KARATE = (
    "2-1 3-1 3-2 4-1 4-2 4-3 5-1 6-1 7-1 7-5 7-6 8-1 8-2 8-3 8-4 9-1 9-3 10-3 11-1 11-5 11-6 12-1 13-1 13-4 14-1 14-2 14-3 14-4 17-6 17-7 18-1 18-2 20-1 20-2 22-1 22-2 26-24 26-25 28-3 28-24 28-25 29-3 "
    "30-24 30-27 31-2 31-9 32-1 32-25 32-26 32-29 33-3 33-9 33-15 33-16 33-19 33-21 33-23 33-24 33-30 33-31 33-32 34-9 34-10 34-14 34-15 34-16 34-19 34-20 34-21 34-23 34-24 34-27 34-28 34-29 34-30 34-31 34-32 34-33"
)


def karate():
    return [(*map(int, p.split("-")), 1.0) for p in KARATE.split()]


def ring_of_cliques(n=8, size=5):
    out = [(i * size + a, i * size + b, 1.0) for i in range(n) for a, b in combinations(range(size), 2)]
    return out + [(i * size, ((i + 1) % n) * size + 1, 1.0) for i in range(n)]


def planted(groups=5, size=12, inside=0.6, outside=0.04):
    r = random.Random(3)
    return [(a, b, float(r.randint(1, 3))) for a, b in combinations(range(groups * size), 2) if r.random() < (inside if a // size == b // size else outside)]


def plain_modularity(rows, community):
    whole, k, inner = 0.0, defaultdict(float), 0.0
    for a, b, w in rows:
        whole += 2 * w
        k[community[a]] += w
        k[community[b]] += w
        inner += 2 * w * (community[a] == community[b])
    return inner / whole - sum((x / whole) ** 2 for x in k.values())


def plain_louvain(rows):
    """Sequential local moves in node order, contraction, levels."""
    near = defaultdict(lambda: defaultdict(float))
    for a, b, w in rows:
        near[a][b] += w
        near[b][a] += w
    member = {u: u for u in near}
    while True:
        k = {u: sum(near[u].values()) for u in near}
        whole, label, total, moved = sum(k.values()), {u: u for u in near}, dict(k), False
        again = True
        while again:
            again = False
            for u in sorted(near):
                links = defaultdict(float)
                for v, w in near[u].items():
                    if v != u:
                        links[label[v]] += w
                own = label[u]
                total[own] -= k[u]
                best = max(((links[c] - k[u] * total[c] / whole, -c) for c in {*links, own}))
                new = -best[1] if best[0] > links[own] - k[u] * total[own] / whole + 1e-12 else own
                total[new] += k[u]
                label[u] = new
                again |= new != own
            moved |= again
            moved |= any(label[u] != u for u in near)
        member = {u: label[c] for u, c in member.items()}
        if not moved or len(set(label.values())) == len(near):
            return member
        up = defaultdict(lambda: defaultdict(float))
        for u in near:
            for v, w in near[u].items():
                up[label[u]][label[v]] += w
        near = up


@pytest.mark.parametrize("rows,least", [(karate(), 0.41), (ring_of_cliques(), 0.74), (planted(), 0.4)], ids=["karate", "cliques", "planted"])
def test_modularity_of_three_graphs(spark, rows, least):
    pairs = spark.createDataFrame(rows, "a long, b long, weight double")
    found = C.louvain(pairs)
    got = {r["id"]: r["community"] for r in found.collect()}
    q = plain_modularity(rows, got)
    assert set(got) == {x for r in rows for x in r[:2]} and all(got[c] == c and c == min(i for i in got if got[i] == c) for c in got.values())
    assert q >= least and q >= plain_modularity(rows, plain_louvain(rows)) - 1e-9
    one = C.modularity(pairs, found).first()
    assert abs(one["modularity"] - q) < 1e-8 and one["communities"] == len(set(got.values()))


def test_edges_of_no_use(spark):
    rows = [("a", "b", 1.0), ("b", "a", 2.0), ("c", "c", 1.0), (None, "x", 1.0), ("y", "z", 0.0), ("d", "e", 5.0)]
    df = spark.createDataFrame(rows, "a string, b string, weight double")
    assert {r["id"]: r["community"] for r in C.louvain(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"}
    assert C.louvain(df.limit(0)).count() == 0


def test_a_round_on_a_small_graph_is_few_jobs_and_one_on_partitions_gives_the_same(spark, monkeypatch):
    rounds, written = [], C.written
    monkeypatch.setattr(C, "written", lambda df, what: rounds.append(what) or written(df, what))
    pairs = spark.createDataFrame([(f"f{a}", f"f{b}", w) for a, b, w in [*planted(3, 6), (4, 4, 2.5)]], "a string, b string, weight double")
    spark.sparkContext.setJobGroup("louvain", "one partition")
    found = sorted(map(tuple, C.louvain(pairs).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("louvain"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 10 * rounds.count("moves")
    monkeypatch.setattr(C, "PARTITION_ROWS", 0)
    assert sorted(map(tuple, C.louvain(pairs).collect())) == found and len({c for _, c in found}) > 1
