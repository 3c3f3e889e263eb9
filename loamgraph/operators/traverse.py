"""Bounded traversals: neighborhoods, impact, paths, ancestry, chains, communities.

Each round joins the frontier with an edge view and drops what is already seen. A round's frontier is cut from its
lineage through the shared checkpoint folder, so a lost executor repeats one round at most; the loop stops early
when a round finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.lineage import cut, written
from loamgraph.sources.model import CONSUMER_LABELS

BOTH_WAYS = ("implements", "inherits")


def resolve_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """Nodes by name: Container.name if it has a dot, else equal names, else names that contain it (case folded)."""
    s = symbol.strip().lower()
    if "." in s and "/" not in s:
        container, name = s.rsplit(".", 1)
        return nodes.where((F.lower("name") == name) & (F.lower("container") == container))
    exact = nodes.where(F.lower("name") == s)
    return nodes.where(F.lower("name").contains(s)) if exact.isEmpty() else exact


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways as (at, to) with its label, confidence, file and line."""
    rest = ["label", "confidence", "file", "line"]
    return edges.select(F.col("source").alias("at"), F.col("target").alias("to"), *rest).unionByName(edges.select(F.col("target").alias("at"), F.col("source").alias("to"), *rest))


def impact_view(edges: DataFrame) -> DataFrame:
    """Edges as impact spreads: consumer relations from what is used to who uses it, others both ways."""
    consumer = F.col("label").isin(*CONSUMER_LABELS, *BOTH_WAYS)
    two_way = ~F.col("label").isin(*CONSUMER_LABELS)
    rest = ["label", "confidence", "file", "line"]
    back = edges.where(consumer | two_way).select(F.col("target").alias("at"), F.col("source").alias("to"), *rest)
    return back.unionByName(edges.where(two_way).select(F.col("source").alias("at"), F.col("target").alias("to"), *rest))


def hops(view: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """All ids within depth hops of the seeds (id): id, hop, via, label, confidence; seeds have hop 0.

    Of several edges that reach an id in the same round, the least (via, label, confidence) is told. The view's four columns
    are written once where there is more than one round, and seeds and each round's frontier are written, so their size is
    known: a small one is broadcast and the view is not shuffled. The edges of a round are dealt by the id that they reach
    before the least is sought: that is a sort, and a scan of the packed view has too many edges for one in memory.
    """
    view = view.select("at", "to", "label", "confidence")
    view = written(view, "view") if depth > 1 else view
    none = F.lit(None).cast("string")
    frontier = seen = written(seeds.select("id").distinct(), "seeds").select("id", F.lit(0).alias("hop"), none.alias("via"), none.alias("label"), none.alias("confidence"))
    for k in range(1, depth + 1):
        met = frontier.select(F.col("id").alias("at")).join(view, "at").select(F.col("to").alias("id"), F.col("at").alias("via"), "label", "confidence").repartition("id")
        step = met.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("via", "label", "confidence")).alias("e"))
        frontier = written(step.select("id", F.lit(k).alias("hop"), "e.via", "e.label", "e.confidence"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reach(view: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """All ids within depth hops of the seeds (id) as hops() finds them, but without reasons: id, hop. Ids are hashed, not sorted."""
    view = written(view.select("at", "to"), "view") if depth > 1 else view.select("at", "to")
    frontier = seen = seeds.select("id").distinct().select("id", F.lit(0).alias("hop"))
    for k in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("at")).join(view, "at").select(F.col("to").alias("id")).distinct()
        frontier = written(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(k).alias("hop")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighborhood(nodes: DataFrame, edges: DataFrame, symbol: str, depth: int = 1) -> DataFrame:
    """Undirected neighborhood of a symbol: id and hop."""
    return reach(undirected(edges), resolve_symbol(nodes, symbol), depth)


def blast_radius(nodes: DataFrame, edges: DataFrame, symbol: str, depth: int = 2) -> DataFrame:
    """What a change of the symbol reaches: id, name, hop, via, label, confidence; without the symbol itself."""
    found = hops(impact_view(edges), resolve_symbol(nodes, symbol), depth).where("hop > 0")
    return found.join(nodes.select("id", "name"), "id", "left").select("id", "name", "hop", "via", "label", "confidence")


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 8) -> DataFrame:
    """One shortest undirected path as rows (step, id), the least of all; no rows if there is none within most hops.

    Levels hold ids alone and are written, so small ones are broadcast and the edges are not shuffled.
    """
    view = written(undirected(edges).select("at", "to"), "view")
    spark = edges.sparkSession
    levels = [spark.createDataFrame([(start,)], "id string")]
    while levels[-1].where(F.col("id") == goal).isEmpty():
        if len(levels) > most:
            return _steps(levels[0].limit(0).select("id", F.array("id").alias("path")))
        step = levels[-1].select(F.col("id").alias("at")).join(view, "at").select(F.col("to").alias("id")).distinct()
        for seen in levels:
            step = step.join(seen, "id", "left_anti")
        levels.append(written(step, "level"))
        if levels[-1].isEmpty():
            return _steps(levels[0].limit(0).select("id", F.array("id").alias("path")))
    # back from the goal: the ids of each level that lie on a shortest path; then forward along these alone, least path first
    on = [spark.createDataFrame([(goal,)], "id string")]
    for level in reversed(levels[:-1]):
        on.append(written(on[-1].select(F.col("id").alias("at")).join(view, "at").select(F.col("to").alias("id")).join(level, "id", "left_semi").distinct(), "on"))
    paths = on.pop().select("id", F.array("id").alias("path"))
    for level in reversed(on):
        step = paths.select(F.col("id").alias("at"), "path").join(view, "at").join(level.select(F.col("id").alias("to")), "to", "left_semi")
        paths = written(step.groupBy(F.col("to").alias("id")).agg(F.min(F.concat("path", F.array("to"))).alias("path")), "paths")
    return _steps(paths)


def _steps(paths: DataFrame) -> DataFrame:
    """The path (of one row at most) as rows (step, id)."""
    return paths.select(F.posexplode("path").alias("step", "id"))


def ancestry(links: DataFrame, most: int = 8) -> DataFrame:
    """All (id, ancestor, level) of child -> parent links (child, parent), each ancestor at its least level."""
    out = links.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("level")).distinct()
    last = out
    for k in range(2, most + 1):
        up = last.join(links, last["ancestor"] == links["child"]).select("id", F.col("parent").alias("ancestor"), F.lit(k).alias("level")).distinct()
        last = cut(up.join(out.select("id", "ancestor"), ["id", "ancestor"], "left_anti").where("id <> ancestor"))
        if last.isEmpty():
            break
        out = out.unionByName(last)
    return out


def call_chain(edges: DataFrame, seeds: DataFrame, depth: int = 3, most_fan_in: int = 20) -> DataFrame:
    """Stages (caller, callee, hop) forward from the seeds over unambiguous uses, skipping callees with high fan-in."""
    calls = edges.where((F.col("confidence") != "AMBIGUOUS") & F.col("label").isin(*CONSUMER_LABELS)).select(F.col("source").alias("caller"), F.col("target").alias("callee")).distinct()
    low = calls.groupBy("callee").agg(F.count("*").alias("fan_in")).where(F.col("fan_in") <= most_fan_in).select("callee")
    calls = calls.join(low, "callee", "left_semi")
    frontier = seeds.select(F.col("id").alias("caller")).distinct()
    seen, out = frontier, None
    for k in range(1, depth + 1):
        stage = cut(frontier.join(calls, "caller").join(seen.select(F.col("caller").alias("callee")), "callee", "left_anti").select("caller", "callee", F.lit(k).alias("hop")))
        out = stage if out is None else out.unionByName(stage)
        frontier = stage.select(F.col("callee").alias("caller")).distinct()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return out


def propagate_labels(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities of a weighted undirected graph (a, b, weight): id, community.

    Synchronous rounds: each id takes the label with most weight among its neighbors and its own (weight: its heaviest
    edge), ties to the least label. A fixed number of rounds, as synchronous labels can alternate.
    """
    both = cut(pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight")))
    own = both.groupBy("id").agg(F.max("weight").alias("weight"))
    labels = own.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("other"), "community"), "other").select("id", "community", "weight").unionByName(labels.join(own, "id").select("id", "community", "weight"))
        sums = votes.groupBy("id", "community").agg(F.sum("weight").alias("votes"))
        labels = cut(sums.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "community")).alias("best")).select("id", "best.community"))
    return labels


def bridges(pairs: DataFrame, communities: DataFrame, limit: int = 20) -> DataFrame:
    """The heaviest pairs whose ends lie in different communities."""
    ca, cb = (communities.select(F.col("id").alias(x), F.col("community").alias(f"{x}_community")) for x in "ab")
    return pairs.join(ca, "a").join(cb, "b").where("a_community <> b_community").select("a", "b", "weight", "a_community", "b_community").orderBy(F.desc("weight"), "a", "b").limit(limit)


def community_stats(pairs: DataFrame, communities: DataFrame, part: Column) -> DataFrame:
    """Size, inner weight and most frequent part (an expression over id; ties to the least) of each community."""
    ca, cb = (communities.select(F.col("id").alias(x), F.col("community").alias(f"{x}_community")) for x in "ab")
    inner = pairs.join(ca, "a").join(cb, "b").where("a_community = b_community").groupBy(F.col("a_community").alias("community")).agg(F.sum("weight").alias("inner_weight"))
    parts = communities.select("community", part.alias("part")).groupBy("community", "part").agg(F.count("*").alias("n"))
    named = parts.groupBy("community").agg(F.sum("n").alias("members"), F.min(F.struct((-F.col("n")).alias("k"), "part")).alias("top"))
    return named.join(inner, "community", "left").select("community", "members", F.coalesce("inner_weight", F.lit(0)).alias("inner_weight"), F.col("top.part").alias("label"))
