"""Communities of a weighted graph by modularity: local moves, contraction, levels.

A round finds each node's best move to a neighbor's community and makes the larger one of two sets of moves. In one, no two moves share a
community that they leave or enter: their gains add up exactly (many in dense graphs). In the other, of adjacent movers only
the one with the greater number drawn for this round moves, so neighbors never move together (many in sparse graphs); as
these are chosen on the same totals, they can still overshoot together. The next round measures the modularity; where it has
not grown, that round is taken back and the first set is made. So modularity grows with every round kept, and a level ends
when no move gains. Then each community becomes a node, and levels go on until one changes nothing.

Edges are rows (u, v, w) both ways, and one row (u, u, w) a node: its loop, 0 where it has none. So a node's strength is the
sum of its rows, and contraction is one sum. On a small graph a round costs what its jobs cost, so it is two queries: one writes
each node's best move, one writes which set it is in; each tells its totals while it is written, and the labels after either
set are columns of the second. What changes from round to round is data, not a literal, so generated code is compiled once.
A graph of few edges, less than a partition's worth, is kept in one partition, where no step needs an exchange; larger ones are
joined and shuffled as Spark plans it. Tables, a row a node, are written to the shared folder. Nothing but totals and counts
comes to the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loamgraph.functions.lineage import written

#: Gains and growth below this share of the whole weight count as none.
LEAST = 1e-12

#: A graph of at most as many rows of edges (a few MB) is one partition.
PARTITION_ROWS = 50_000

#: {edges}, {labels} and {moves} are tables; HASH(x) is a join hint where the graph is one partition, else nothing.
#: The joins are left ones, though each row has its match in MOVES: Spark then knows that their rows are still in one partition.
MOVES = f"""
WITH mine AS (
  SELECT HASH(t) l.u, l.c, l.turn, t.total FROM {{labels}} l LEFT JOIN (SELECT c, sum(k) AS total FROM {{labels}} GROUP BY c) t ON l.c = t.c),
near AS (  -- a node meets its own community at least by its loop
  SELECT HASH(m) e.u, m.c AS goal, sum(if(e.u = e.v, 0D, e.w)) AS w, sum(if(e.u = e.v, e.w, 0D)) AS loop, max(e.u = e.v) AS own, max(e.k) AS k, max(m.turn) AS turn, max(m.total) AS total
  FROM {{edges}} e LEFT JOIN mine m ON e.v = m.u GROUP BY e.u, m.c),
best AS (  -- part: what a move gains but for what is the same for all goals of a node
  SELECT u, max(if(own, goal, NULL)) AS c, max(k) AS k, max(turn) AS turn, max(if(own, total, NULL)) AS total, sum(if(own, w, 0D)) AS own, sum(loop) AS loop,
    min(if(own, NULL, struct(k * total / (:whole * :whole) - w / :whole AS part, goal))) AS b
  FROM near GROUP BY u),
told AS (SELECT *, 2 * (k * (total - k) / (:whole * :whole) - own / :whole - b.part) AS gain FROM best)
SELECT u, c, k, turn + 1 AS turn, if(gain > {LEAST!r}D, b.goal, NULL) AS target, if(gain > {LEAST!r}D, gain, NULL) AS gain, own + loop AS inner, total FROM told"""

PICKS = """
WITH movers AS (SELECT u, c, target, turn, struct(-gain AS g, u) AS rank FROM {moves} WHERE target IS NOT NULL),
beaten AS (
  SELECT HASH(m) DISTINCT if(m.u IS NULL, NULL, e.u) AS u
  FROM {edges} e LEFT JOIN movers m ON e.v = m.u AND struct(xxhash64(m.turn, e.u) AS h, e.u AS u) < struct(xxhash64(m.turn, e.v) AS h, e.v AS u)),
best AS (SELECT min(rank).u AS u FROM (SELECT explode(array(c, target)) AS at, rank FROM movers) GROUP BY at),
won AS (SELECT u, count(*) AS n FROM best GROUP BY u)
SELECT HASH(b, w) m.u, m.c, m.k, m.turn, m.target, m.target IS NOT NULL AND b.u IS NULL AS apart, coalesce(w.n, 0) = 2 AS alone
FROM {moves} m LEFT JOIN beaten b ON m.u = b.u LEFT JOIN won w ON m.u = w.u"""


class Graph(NamedTuple):
    """Edges with k, the strength of u, the sum of all w (None without any), and whether they are few."""

    edges: DataFrame
    whole: float | None
    few: bool

    @staticmethod
    def of(edges: DataFrame) -> Graph:
        """The graph of edges (u, v, w) that are read from a table."""
        rows, whole = edges.agg(F.count("*"), F.sum("w")).first()
        edges = written(edges.join(edges.groupBy("u").agg(F.sum("w").alias("k")), "u"), "edges")
        few = rows <= PARTITION_ROWS
        return Graph(edges.coalesce(1) if few else edges, whole, few)

    def kept(self, df: DataFrame, what: str) -> DataFrame:
        """df written, a row a node."""
        out = written(df, what)
        return out.coalesce(1) if self.few else out

    def run(self, sql: str, what: str, totals: list[Column], **tables: DataFrame) -> tuple[DataFrame, dict]:
        """The rows of a query written, and totals over them, taken while they are written."""
        seen = Observation(what)
        for name in ("HASH(t)", "HASH(m)", "HASH(b, w)"):
            sql = sql.replace(name, f"/*+ SHUFFLE_{name} */" if self.few else "")
        out = self.edges.sparkSession.sql(sql, {"whole": self.whole} if ":whole" in sql else None, edges=self.edges, **tables)
        return self.kept(out.observe(seen, *totals), what), seen.get

    def strength(self) -> DataFrame:
        """u and k (the sum of its rows) of every node."""
        return self.kept(self.edges.where("u = v").select("u", "k"), "strength")

    def moves(self, labels: DataFrame) -> tuple[DataFrame, float, int]:
        """Each node's best move (u, c, k, turn, target, gain; target null where none gains), the modularity of labels, and how many gain.

        labels has u, c, k and turn, the turns so far. Gains are in units of modularity; equal ones go to the least community.
        """
        totals = [F.sum("inner").alias("inner"), F.sum(F.expr("k * total").alias("square")).alias("square"), F.count("target").alias("n")]
        moves, told = self.run(MOVES, "moves", totals, labels=labels)
        return moves, told["inner"] / self.whole - told["square"] / self.whole / self.whole, told["n"]

    def picks(self, moves: DataFrame) -> tuple[DataFrame, int, int]:
        """moves with two flags, and how many rows have each.

        apart: no adjacent mover outranks this one by the turn's numbers. alone: it is the best mover of both communities that it touches.
        """
        picks, told = self.run(PICKS, "picks", [F.count_if("apart").alias("apart"), F.count_if("alone").alias("alone")], moves=moves)
        return picks, told["apart"], told["alone"]

    def contracted(self, labels: DataFrame) -> Graph:
        """The graph of the communities of labels."""
        ends = self.edges.join(labels.select("u", F.col("c").alias("cu")), "u").join(labels.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v")
        return Graph.of(written(ends.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "contracted"))


def _after(picks: DataFrame, flag: str) -> DataFrame:
    """labels after the moves with a flag."""
    return picks.selectExpr("u", f"if({flag}, target, c) AS c", "k", "turn")


def _settle(graph: Graph, labels: DataFrame, turn: int) -> tuple[DataFrame, int, bool]:
    """labels (u, c, k, turn) after moves until none gains, the turns so far, and whether any was made."""
    before, picks, changed = None, None, False
    while True:
        moves, q, gaining = graph.moves(labels)
        if before is not None and q <= before + LEAST:  # the moves of that round spoilt each other
            labels, before = _after(picks, "alone"), None
            continue
        if not gaining:
            return labels, turn, changed
        picks, apart, alone = graph.picks(moves)
        wide, turn, changed = apart > alone, turn + 1, True
        labels, before = _after(picks, "apart" if wide else "alone"), q if wide else None


def louvain(pairs: DataFrame) -> DataFrame:
    """id and community (its least id) of every id of weighted pairs (a, b, weight): repeated pairs add up, weights are positive.

    When the levels are done, single ids are moved once more from there; where that gains, levels start again from the result.
    Pairs with a null end or a weight of 0 or less are left out, a pair of an id with itself is a loop. Ids are of any ordered type.
    """
    given = pairs.where("a is not null and b is not null and weight > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("w"))
    given = given.groupBy("a", "b").agg(F.sum("w").alias("w"))
    row = lambda u, v, w: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), w.alias("w"))
    both = given.select(F.explode(F.array(row("a", "b", F.col("w")), row("b", "a", F.col("w")), row("a", "a", F.lit(0.0)), row("b", "b", F.lit(0.0)))).alias("e")).select("e.*")
    graph = Graph.of(written(both.groupBy("u", "v").agg(F.sum("w").alias("w")), "pairs"))
    ids = graph.strength()
    members, turn = ids.select("u", F.col("u").alias("c")), 0
    while graph.whole:
        labels, turn, moved = _settle(graph, members.join(ids, "u").select("u", "c", "k", F.lit(turn).alias("turn")), turn)
        members = labels.select("u", "c")
        if not moved:
            break
        level = graph
        while True:
            level = level.contracted(labels)
            labels, turn, grown = _settle(level, level.strength().select("u", F.col("u").alias("c"), "k", F.lit(turn).alias("turn")), turn)
            if not grown:
                break
            members = graph.kept(members.withColumnRenamed("c", "at").join(labels.select(F.col("u").alias("at"), "c"), "at").select("u", "c"), "members")
    least = members.groupBy("c").agg(F.min("u").alias("community"))
    return members.join(least, "c").select(F.col("u").alias("id"), "community")


def modularity(pairs: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: the modularity of communities (id, community) of weighted pairs (a, b, weight), and how many there are."""
    at = lambda c: communities.select(F.col("id").alias(c), F.col("community").alias(f"{c}_c"))
    met = pairs.where("a is not null and b is not null and weight > 0").join(at("a"), "a").join(at("b"), "b")
    halves = met.select(F.explode(F.array(F.struct(F.col("a_c").alias("c"), F.col("b_c").alias("o"), "weight"), F.struct(F.col("b_c").alias("c"), F.col("a_c").alias("o"), "weight"))).alias("h")).select("h.*")
    sums = halves.groupBy("c").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("c") == F.col("o"), F.col("weight")).otherwise(0)).alias("inner"))
    whole = sums.agg(F.sum("k").alias("whole"))
    part = F.sum(F.col("inner") / F.col("whole") - F.col("k") / F.col("whole") * (F.col("k") / F.col("whole")))
    return sums.join(F.broadcast(whole)).agg(F.round(part, 9).alias("modularity"), F.count("*").alias("communities"))  # one row
