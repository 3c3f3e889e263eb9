"""Composed plans: intent classification, evidence packages under a budget, set cover, impact risk, answer validation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as X
from loamgraph.functions.lineage import written
from loamgraph.operators import graph as G
from loamgraph.operators import traverse as T
from loamgraph.sources.model import STRUCTURAL

#: Intents in the order that breaks ties, with their cues and weights. Fixed values.
CUES = {
    "flow": {"flow": 3, "call": 2, "chain": 3, "path": 2, "how does": 2},
    "impact": {"impact": 3, "break": 2, "change": 2, "affect": 3, "depends": 2},
    "tests": {"test": 3, "coverage": 2, "assert": 2},
    "persistence": {"store": 2, "database": 3, "save": 2, "table": 2},
    "bindings": {"route": 3, "bind": 2, "register": 2, "handler": 2},
    "overview": {"overview": 3, "architecture": 3, "summary": 2, "explain": 1},
}


def cue_score(text: Column, cues: dict[str, int]) -> Column:
    """Sum of the weights of the cues that a text has."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(0)
    for cue, weight in cues.items():
        out = out + F.when(low.contains(cue), weight).otherwise(0)
    return out


def classify_intent(text: Column) -> Column:
    """The intent with the highest cue score, the first of CUES on ties; overview where there is no cue."""
    scores = {k: cue_score(text, c) for k, c in CUES.items()}
    top, out = F.greatest(*scores.values()), F.lit("overview")
    for k in reversed(list(CUES)):
        out = F.when((scores[k] == top) & (top > 0), k).otherwise(out)
    return out


def concept_terms(query: str) -> list[str]:
    """The first twelve distinct words of three letters or more of a query in lower case."""
    return list(dict.fromkeys(t for t in re.findall(r"[\w.]+", query.lower().strip()) if len(t) >= 3))[:12]


def concept_search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Nodes by 100 if the query stands in their text, 10 a term, 30 if a term is the name, and up to 10 for the degree; ties by name and id."""
    q, terms = query.lower().strip(), concept_terms(query)
    name = F.lower(F.coalesce("name", F.lit("")))
    text = F.concat(name, F.lit(" "), F.lower(F.coalesce("container", F.lit(""))))
    matched = sum((F.when(text.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    whole = text.contains(q) if q else F.lit(False)
    score = F.when(whole, 100).otherwise(0) + 10 * matched + F.when(name.isin(*terms) if terms else F.lit(False), 30).otherwise(0)
    met = nodes.where(whole | (matched > 0)).select("id", "name", score.alias("score"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).join(met.select("id"), "id", "left_semi").groupBy("id").agg(F.least(F.lit(10), F.count("*")).alias("links"))
    return met.join(ends, "id", "left").select("id", "name", (F.col("score") + F.coalesce("links", F.lit(0))).cast("long").alias("score")).orderBy(F.desc("score"), "name", "id").limit(limit)


def overview(nodes: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """Central nodes, one of each kind in turn: kind, id, degree, turn."""
    met = nodes.join(G.degree(edges), "id").select("id", "kind", "degree")
    turn = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("degree"), "id"))
    return met.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", "kind").limit(limit)


def greedy_cover(candidates: dict[str, set[str]], most: int = 20) -> list[str]:
    """Candidates that take the most uncovered concerns in turn; ties to the lesser name. For collected, bounded input."""
    left, out = set().union(*candidates.values()) if candidates else set(), []
    while left and len(out) < most:
        best = min(candidates, key=lambda c: (-len(candidates[c] & left), c))
        if not candidates[best] & left:
            break
        out.append(best)
        left -= candidates[best]
    return out


def evidence_package(nodes: DataFrame, edges: DataFrame, query: str, depth: int = 1, budget: int = 400) -> DataFrame:
    """Nodes around the best matches of a query, near ones first, within a token budget: id, name, hop, cost, alias."""
    seeds = concept_search(nodes, edges, query, 5)
    near = T.hops(T.undirected(edges), seeds, depth).select("id", "hop").join(nodes.select("id", "name", "file"), "id")
    capped = near.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("hop", "id"))).where("place <= 2").orderBy("hop", "id").limit(2 * budget)
    order = Window.partitionBy(F.lit(0)).orderBy("hop", "id")  # at most 2 * budget rows
    cost = X.token_estimate(F.to_json(F.struct("id", "name", "file"))) + 1
    spent = capped.withColumn("cost", cost).withColumn("spent", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order))
    return spent.where((F.col("spent") <= budget) | (F.col("n") == 1)).select("id", "name", "hop", "cost", F.concat(F.lit("N"), F.col("n").cast("string")).alias("alias"))


#: Suffixes of files that count as documents in a change. Fixed values.
PROSE = (".md", ".txt", ".rst", ".adoc", ".markdown")


def risk_score(files: DataFrame, symbols: DataFrame, impacted: DataFrame) -> DataFrame:
    """One row: the risk of a change, 0 to 100, with its level and factors.

    files: path of each changed file; symbols: signature (whether a changed symbol's signature changed); impacted: hop, label.
    5 a code file, 2 a document, 12 a changed signature, 3 a direct dependent, 1 a further one, and up to 5 for what is contained.
    """
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    f = files.agg(F.count_if(~suffix.isin(*PROSE)).alias("code_files"), F.count_if(suffix.isin(*PROSE)).alias("doc_files"))
    s = symbols.agg(F.count_if(F.col("signature")).alias("signature_changes"))
    held = F.col("label").isin(*STRUCTURAL)
    i = impacted.agg(F.count_if((F.col("hop") == 1) & ~held).alias("direct"), F.count_if(held).alias("containment"), F.count_if((F.col("hop") > 1) & ~held).alias("transitive"))
    c = f.join(F.broadcast(s)).join(F.broadcast(i))  # one-row sides
    score = 5 * F.col("code_files") + 2 * F.col("doc_files") + 12 * F.col("signature_changes") + 3 * F.col("direct") + F.col("transitive") + F.least(F.lit(5), F.floor(F.col("containment") / 8))
    c = c.withColumn("score", F.least(F.lit(100), score).cast("long"))
    return c.withColumn("level", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 25, "medium").otherwise("low"))


def validate_package(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, dangling ends, edges without a location, ambiguous edges.

    Ends are counted by id before they meet the nodes, so no edge is shuffled. Edges with two unknown ends, counted twice by
    that, are found by the unknown ids alone.
    """
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    unknown = written(ends.join(nodes.select("id"), "id", "left_anti"), "unknown")
    once = unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("met")).first()["met"]
    twice = 0
    if once:
        at = lambda end: F.col(end).eqNullSafe(F.col("unknown"))
        ids = unknown.select(F.col("id").alias("unknown"))
        both = edges.join(ids, at("source"), "left_semi").join(ids, at("target"), "left_semi")
        twice = both.count()
    return edges.agg(
        F.count("*").alias("edges"), F.lit(once - twice).cast("long").alias("dangling"), F.count_if(F.col("file").isNull() | F.col("line").isNull()).alias("unlocated"),
        F.count_if(F.col("confidence") == "AMBIGUOUS").alias("ambiguous"),
    )


def validate_claims(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Sentences of answers (answer_id, text) as claims, with a verdict by how many of their long words known (term) has."""
    claims = answers.select("answer_id", F.posexplode(F.filter(F.split("text", r"[.!?]\s+"), lambda s: F.length(s) > 0)).alias("claim", "sentence"))
    words = claims.select("answer_id", "claim", F.explode_outer(F.array_distinct(F.filter(X.tokens(F.col("sentence")), lambda t: F.length(t) >= 5))).alias("term"))
    met = words.join(known.select("term").distinct().withColumn("hit", F.lit(1)), "term", "left")
    per = met.groupBy("answer_id", "claim").agg(F.count("term").alias("terms"), F.count("hit").alias("supported"))
    share = F.try_divide(F.col("supported"), F.col("terms"))
    return per.withColumn("verdict", F.when(F.col("terms") == 0, "abstained").when(share == 1, "supported").when(share >= 0.5, "partially_supported").when(share > 0, "ambiguous").otherwise("unsupported"))


def merge_order(branches: list[dict]) -> list[str]:
    """Branches in merge order: dependencies first, then fewer conflicts, less exposure, name; a cycle is cut by the same key."""
    left, out = {b["name"]: b for b in branches}, []
    while left:
        ready = [b for b in left.values() if not set(b.get("after", ())) & left.keys() - {b["name"]}] or list(left.values())
        best = min(ready, key=lambda b: (b.get("conflicts", 0), b.get("exposure", 0), b["name"]))
        out.append(best["name"])
        del left[best["name"]]
    return out
