"""Operators over nodes and edges: calibration, deduplication, degree, hubs, quality, pairs, selection, resolution."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import paths
from loamgraph.functions.lineage import written
from loamgraph.sources.model import CONFIDENCE_RANK, CONSUMER_LABELS, STRUCTURAL

#: Base score by confidence. Fixed values.
CONFIDENCE_BASE = {"AMBIGUOUS": 0.35, "INFERRED": 0.58, "EXTRACTED": 0.82, "REVIEWED": 0.94, "TYPED": 0.98}


def _lookup(column: Column, values: dict, otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def confidence_rank(confidence: Column) -> Column:
    """Order of a confidence level; -1 if unknown."""
    return _lookup(F.upper(confidence), CONFIDENCE_RANK, -1).cast("int")


def confidence_score(confidence: Column, candidates: Column, resolution_score: Column, file: Column, line: Column) -> Column:
    """0.05 to 0.99: base by level, less for rival candidates, more for the resolver's score and a location."""
    base = _lookup(F.upper(F.coalesce(confidence, F.lit("INFERRED"))), CONFIDENCE_BASE, 0.5)
    rivals = F.least(F.lit(0.3), (F.greatest(candidates, F.lit(1)) - 1) * F.lit(0.06))
    located = F.when((F.coalesce(file, F.lit("")) != "") & (F.coalesce(line, F.lit(0)) != 0), 0.04).otherwise(0.0)
    score = base - rivals + F.least(F.lit(0.12), F.coalesce(resolution_score, F.lit(0.0)) * F.lit(0.01)) + located
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), score)), 3)


def scored(edges: DataFrame) -> DataFrame:
    """Edges with confidence_score."""
    return edges.withColumn("confidence_score", confidence_score(F.col("confidence"), F.col("candidates"), F.col("resolution_score"), F.col("file"), F.col("line")))


def dedup_edges(edges: DataFrame, keys: tuple[str, ...] = ("source", "target", "label", "file", "line")) -> DataFrame:
    """One edge a key, the strongest by (rank, score), with how many there were; ties go to the least location.

    An aggregate with a struct instead of a window: it combines before the shuffle.
    """
    rest = [c for c in (*edges.columns, "confidence_score") if c not in keys]
    strength = F.struct(-confidence_rank(F.col("confidence")), -F.col("confidence_score"), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)))
    best = scored(edges).groupBy(*keys).agg(F.min_by(F.struct(*rest), strength).alias("best"), F.count("*").alias("occurrences"))
    return best.select(*keys, "best.*", "occurrences")


def degree(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree and degree of every endpoint: one shuffle for both directions."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count("*").alias("degree"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both endpoints among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


#: Names of self-test entry points in production files. Fixed value.
TEST_NAME = r"(^test_|^test[A-Z]|Tests?$|_test$)"


def god_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 10, most_homonyms: int = 2, containers: tuple[str, ...] = ("region", "nation")) -> DataFrame:
    """The most connected production symbols: no containers, no test names, nothing without a line, no names with more than most_homonyms definitions.

    Containers and nodes without a file are no definitions. Definitions are counted where a name's nodes are sorted, in one
    shuffle by name; a node without a name is none.
    """
    symbols = nodes.where(~F.col("kind").isin(*containers) & (F.coalesce("file", F.lit("")) != "") & F.col("name").isNotNull())
    rare = symbols.withColumn("definitions", F.count("*").over(Window.partitionBy("name"))).where(F.col("definitions") <= most_homonyms)
    live = rare.where(paths.production(F.col("file")) & (F.coalesce("line", F.lit(0)) != 0) & ~F.col("name").rlike(TEST_NAME))
    hubs = live.join(degree(edges.where(~F.col("label").isin(*STRUCTURAL))), "id")
    return hubs.select("id", "name", "file", "line", "degree").orderBy(F.desc("degree"), "file", "line", "id").limit(limit)


def quality(nodes: DataFrame, edges: DataFrame, structural_kinds: tuple[str, ...] = ("class", "function", "method", "interface", "struct")) -> DataFrame:
    """One row: counts by confidence, isolated nodes, located structural nodes, rates and health of a graph.

    health: 100 times the share of edges that are neither ambiguous nor unresolved; 0 without nodes.
    """
    c = lambda level: F.count_if(F.upper("confidence") == level)
    e = edges.agg(F.count("*").alias("edges"), *[c(level).alias(level.lower()) for level in ("EXTRACTED", "INFERRED", "AMBIGUOUS", "UNRESOLVED")])
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    shape = F.col("kind").isin(*structural_kinds)
    placed = shape & (F.coalesce("file", F.lit("")) != "") & (F.coalesce("line", F.lit(0)) != 0)
    n = nodes.select("id", "kind", "file", "line").join(ends.withColumn("met", F.lit(True)), "id", "left").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("met").isNull()).alias("isolated"), F.count_if(shape).alias("structural"), F.count_if(placed).alias("located")
    )
    total = F.greatest(F.lit(1), F.col("edges"))
    health = F.round(F.greatest(F.lit(0.0), 1 - (F.col("ambiguous") + F.col("unresolved")) / total) * 100, 2)
    return n.join(F.broadcast(e)).select(  # two one-row sides
        "nodes", "isolated", "structural", "located", "edges", "extracted", "inferred", "ambiguous", "unresolved", F.round(F.col("located") / F.greatest(F.lit(1), F.col("structural")), 4).alias("location_coverage"),
        F.round(F.col("ambiguous") / total, 4).alias("ambiguous_rate"), F.round(F.col("inferred") / total, 4).alias("inferred_rate"), F.when(F.col("nodes") == 0, 0.0).otherwise(health).alias("health"),
    )


def label_confidence(edges: DataFrame) -> DataFrame:
    """Edges by label and confidence."""
    return edges.groupBy("label", "confidence").agg(F.count("*").alias("relations"))


def file_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected weighted pairs of production files; containment does not count."""
    files = nodes.where(paths.production(F.col("file"))).select("id", "file")
    met = (
        edges.where(~F.col("label").isin(*STRUCTURAL)).select("source", "target")
        .join(files.select(F.col("id").alias("source"), F.col("file").alias("sf")), "source")
        .join(files.select(F.col("id").alias("target"), F.col("file").alias("tf")), "target")
    )
    return met.where("sf <> tf").groupBy(F.least("sf", "tf").alias("a"), F.greatest("sf", "tf").alias("b")).agg(F.count("*").alias("weight"))


def crossings(nodes: DataFrame, edges: DataFrame, part: Column, limit: int = 8) -> DataFrame:
    """Extracted edges between subsystems (an expression over a node's columns), the most frequent pairs."""
    sub = nodes.select("id", part.alias("part"))
    met = (
        edges.where((F.col("confidence") == "EXTRACTED") & ~F.col("label").isin(*STRUCTURAL)).select("source", "target")
        .join(sub.select(F.col("id").alias("source"), F.col("part").alias("source_part")), "source")
        .join(sub.select(F.col("id").alias("target"), F.col("part").alias("target_part")), "target")
    )
    pairs = met.where("source_part <> target_part").groupBy("source_part", "target_part").agg(F.count("*").alias("relations"))
    return pairs.orderBy(F.desc("relations"), "source_part", "target_part").limit(limit)


def direct_consumers(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Sources of consumer edges into the anchors (id)."""
    return edges.where(F.col("label").isin(*CONSUMER_LABELS)).join(anchors.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(F.col("source").alias("id")).distinct()


def indirect_consumers(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Consumers of direct consumers that are neither direct consumers nor anchors."""
    direct = direct_consumers(edges, anchors)
    return direct_consumers(edges, direct).join(direct, "id", "left_anti").join(anchors.select("id"), "id", "left_anti")


def consumer_summary(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, listed: int = 5) -> DataFrame:
    """Consumers by file: how many, the first few by id, and how many remain."""
    met = direct_consumers(edges, anchors).join(nodes.select("id", "file"), "id")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("id")))
    return ranked.groupBy("file").agg(
        F.count("*").alias("consumers"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rank") <= listed, F.col("id")))), ",").alias("first_ids")
    ).withColumn("remaining", F.greatest(F.lit(0), F.col("consumers") - listed).cast("long"))


def covers(have: DataFrame, required: DataFrame) -> DataFrame:
    """Relational division: (owner, group) where owner's items include all items of the group.

    have: owner, item; required: group, item; both distinct. A group without items is covered by none.
    """
    known = have.groupBy("item").agg(F.count("*").alias("owners"))
    counted = required.join(known, "item", "left").withColumn("owners", F.coalesce("owners", F.lit(0)))
    # the item that fewest owners have gives the candidates; the next one leaves few of them
    place = F.row_number().over(Window.partitionBy("group").orderBy("owners", "item"))
    items = counted.withColumn("place", place).withColumn("needed", F.count("*").over(Window.partitionBy("group")))
    second = items.where("place = 2").select("group", F.col("item").alias("second"))
    first = items.where("place = 1 and owners > 0").select("group", "item", "needed").join(second, "group", "left").join(have, "item").select("owner", "group", "second", "needed")
    both = first.where("needed > 1").join(have.withColumnRenamed("item", "second"), ["owner", "second"], "left_semi").select("owner", "group", "needed")
    rest = both.where("needed > 2").join(items.where("place > 2").select("group", "item"), "group").join(have, ["owner", "item"])
    full = rest.groupBy("owner", "group", "needed").agg(F.count("*").alias("got")).where("got = needed - 2")
    return first.where("needed = 1").select("owner", "group").unionByName(both.where("needed = 2").select("owner", "group")).unionByName(full.select("owner", "group"))


def same_name_across(nodes: DataFrame, project: Column, most: int = 12) -> DataFrame:
    """Consecutive ids of one folded name in different projects; names with more than most definitions are skipped."""
    named = nodes.select("id", F.lower("name").alias("folded"), project.alias("project"))
    fit = named.groupBy("folded").agg(F.count("*").alias("n"), F.count_distinct("project").alias("projects")).where((F.col("n") <= most) & (F.col("projects") >= 2)).select("folded")
    w = Window.partitionBy("folded").orderBy("id")
    linked = named.join(fit, "folded", "left_semi").withColumn("next_id", F.lead("id").over(w)).withColumn("next_project", F.lead("project").over(w))
    return linked.where("next_id is not null and project <> next_project").select(F.col("id").alias("source"), F.col("next_id").alias("target"), "folded")


def number_overloads(nodes: DataFrame, callable_kinds: tuple[str, ...] = ("method", "function")) -> DataFrame:
    """Ids of definitions (id, kind, file, name, line, arity) in line order: the first of a (file, name) plain, then /arity, then @line.

    arity may be null: then the line stands for it. A repeated definition of another kind has no id (null).
    """
    by_name = Window.partitionBy("file", "name").orderBy("line", "id")
    suffix = F.coalesce(F.col("arity").cast("string"), F.col("line").cast("string"))
    placed = nodes.withColumn("place", F.row_number().over(by_name)).withColumn("suffix", suffix)
    again = placed.withColumn("nth", F.row_number().over(Window.partitionBy("file", "name", "suffix", F.col("place") == 1).orderBy("line", "id")))
    base = F.concat(F.lit("symbol:"), "file", F.lit(":"), "name")
    overload = F.concat(base, F.lit("/"), "suffix")
    return again.select(
        "id", F.when(F.col("place") == 1, base).when(F.col("kind").isin(*callable_kinds), F.when(F.col("nth") == 1, overload).otherwise(F.concat(overload, F.lit("@"), F.col("line").cast("string")))).alias("qualified")
    )


def apply_reviews(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ambiguous edges after review: accepted ones are REVIEWED, rejected ones go, others stay.

    decisions: source, target, label, decision.
    """
    met = edges.join(decisions, ["source", "target", "label"], "left")
    amb = F.col("confidence") == "AMBIGUOUS"
    out = met.where(~(amb & (F.coalesce("decision", F.lit("")) == "rejected")))
    return out.withColumn("confidence", F.when(amb & (F.col("decision") == "accepted"), "REVIEWED").otherwise(F.col("confidence"))).drop("decision")


def relation_key(source: Column, target: Column, label: Column, file: Column, line: Column) -> Column:
    """A stable key of a relation: 20 hex digits of the SHA-256 of its fields, parted by zero characters."""
    fields = [F.coalesce(c.cast("string"), F.lit("")) for c in (source, target, label, file)] + [F.coalesce(F.nullif(line.cast("string"), F.lit("0")), F.lit(""))]
    return F.substring(F.sha2(F.encode(F.concat_ws("\0", *fields), "UTF-8"), 256), 1, 20)


def ambiguity_queue(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """All ambiguous and reviewed edges with their key and decision (null: pending); decisions: review_key, decision."""
    open_ = edges.where(F.upper(F.coalesce("confidence", F.lit(""))).isin("AMBIGUOUS", "REVIEWED"))
    keyed = open_.withColumn("review_key", relation_key(*[F.col(c) for c in ("source", "target", "label", "file", "line")]))
    return keyed.join(decisions.select("review_key", "decision"), "review_key", "left")


def merge_typed(edges: DataFrame, sidecar: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sidecar relations as TYPED edges where both endpoints are known; and those rejected."""
    ids = nodes.select("id")
    good = sidecar.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    bad = sidecar.join(good.select("source", "target", "label"), ["source", "target", "label"], "left_anti")
    return edges.unionByName(good.withColumn("confidence", F.lit("TYPED")), allowMissingColumns=True), bad


def enclosing(points: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """The narrowest span (id, start, end) around each point (point_id, line) of the same keys; none: left out.

    The equality keys carry the join; the range is checked on its matches, and the narrowest span is an aggregate.
    """
    met = points.join(spans, list(keys)).where("line >= start and line <= end")
    return met.groupBy("point_id").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("width"), "id")).alias("best")).select("point_id", F.col("best.id").alias("id"), F.col("best.width").alias("width"))


def overlapping(ranges: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Spans that begin inside a changed range (range_id, lo, hi), else the narrowest span around it."""
    met = ranges.join(spans, list(keys)).where("start <= hi and end >= lo").withColumn("inside", F.col("start") >= F.col("lo"))
    some = F.max("inside").over(Window.partitionBy("range_id"))
    rank = F.row_number().over(Window.partitionBy("range_id", "inside").orderBy(F.col("end") - F.col("start"), "id"))
    return met.withColumn("some", some).withColumn("rank", rank).where("inside or (not some and rank = 1)").select("range_id", "id", "inside")


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str) -> DataFrame:
    """As-of join: each left row with the value of the last right row of its keys at or before it (null: none).

    One shuffle: both sides are stacked, and a running last value passes from right rows to left rows.
    """
    tag = F.lit(1).alias("_side")
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    stacked = left.withColumn("_row", F.struct(*left.columns)).select(*keys, F.col(left_at).alias("_at"), tag, F.lit(None).cast(right.schema[value].dataType).alias("_value"), "_row").unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stacked.withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_last").alias(value))


def resolve_names(calls: DataFrame, symbols: DataFrame, most_ties: int = 4) -> DataFrame:
    """Call sites (call_id, name, file, container, arity) to symbols by additive evidence; best ties up to most_ties stay.

    symbols: id, name, file, container, arity (a whole number). Same file 4, same container 5, same arity 5 (close: 3).
    Symbols are counted by each set of equal attributes and looked up by key, so no call meets all symbols of its name.
    Two sets of one score have no symbol in common at the best score: it would be equal in both, for more. Keys are made
    of distinct attributes, not of symbols, and every join is by sort: sizes told before a row becomes up to 16 keys
    would let the driver collect a side for a broadcast that grows with the symbols.
    """
    signature = ["name", "file", "container", "arity"]
    keys = ["k_name", "k_set", "k_file", "k_container", "k_arity"]
    alike = symbols.groupBy(*signature).agg(F.count("*").alias("alike"))
    known = _evidence_keys(alike.select(*signature, *[F.col(c).alias(f"s_{c}") for c in signature[1:]], "alike"), *[f"s_{c}" for c in signature[1:]], "alike", probes=False)
    probes = _evidence_keys(calls.select(*signature).distinct(), *signature[1:], probes=True)
    met = _same_keys(probes, known.groupBy(*keys).agg(F.sum("alike").alias("n")), keys)
    w = Window.partitionBy("k_name", *signature[1:])
    won = written(met.withColumn("best", F.rank().over(w.orderBy(F.desc("score")))).where("best = 1").withColumn("all", F.sum("n").over(w)), "won")
    few = _same_keys(won.where(F.col("all") <= most_ties), known.where(F.col("alike") <= most_ties).drop("score", "alike"), keys)
    few = few.select(F.col("k_name").alias("name"), *[F.col(f"s_{c}").alias(c) for c in signature[1:]], F.struct(*signature[1:]).alias("asked"))
    found = _same_keys(few, symbols.select("id", *signature), signature).groupBy("name", "asked").agg(F.collect_list(F.struct("id")).alias("ids"))  # most_ties at most
    told = won.select(F.col("k_name").alias("name"), *signature[1:], "score", F.col("all").alias("n")).distinct()
    told = _same_keys(told, found.select("name", "asked.*", "ids"), signature, "left")
    placed = _same_keys(calls.select("call_id", *signature), told, signature).select("call_id", "score", "n", "ids")
    w = Window.partitionBy("call_id")
    top = placed.withColumn("rank", F.rank().over(w.orderBy(F.desc("score")))).where("rank = 1").withColumn("ties", F.sum("n").over(w)).where(F.col("ties") <= most_ties)
    return top.withColumn("met", F.explode("ids")).select("call_id", "met.id", "score", F.col("ties").cast("long").alias("ties"), F.when(F.col("ties") > 1, "AMBIGUOUS").otherwise("EXTRACTED").alias("confidence"))


def _evidence_keys(rows: DataFrame, *kept: str, probes: bool) -> DataFrame:
    """Rows (name, file, container, arity) once for each set of attributes that can be equal: k_name, k_set, k_file, k_container, k_arity, score.

    Attributes outside the set are null; a row without one of the set's attributes has no such key. Probes also look
    for the arities next to their own, under the key of an equal one.
    """
    nothing = F.lit(None)
    sets = []
    for f in (False, True):
        for c in (False, True):
            for step, points in ((None, 0), (0, 5)) + (((-1, 3), (1, 3)) if probes else ()):
                arity = nothing if step is None else F.col("arity") + F.lit(step)
                told = [F.col(x).isNotNull() for x, on in (("file", f), ("container", c), ("arity", step is not None)) if on]
                fields = F.struct(
                    F.lit(4 * f + 2 * c + (step is not None)).alias("k_set"), (F.col("file") if f else nothing.cast("string")).alias("k_file"),
                    (F.col("container") if c else nothing.cast("string")).alias("k_container"), arity.cast("long").alias("k_arity"), F.lit(4 * f + 5 * c + points).alias("score"),
                )
                sets.append(F.when(functools.reduce(lambda x, y: x & y, told, F.lit(True)), fields))
    return rows.where("name is not null").select(F.col("name").alias("k_name"), *kept, F.explode(F.array_compact(F.array(*sets))).alias("k")).select("k_name", *kept, "k.*")


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which all but the first may be null on both sides; neither side is broadcast, whatever its size is thought to be."""
    other = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns if c in keys or c not in left.columns])
    same = [left[keys[0]] == F.col(f"_{keys[0]}"), *[left[k].eqNullSafe(F.col(f"_{k}")) for k in keys[1:]]]
    return left.join(other.hint("merge"), same, how).drop(*[f"_{k}" for k in keys])
