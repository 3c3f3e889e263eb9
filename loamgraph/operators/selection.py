"""Choosing rows under limits: running sums over a total order, several ranked lists under one budget, greedy covers."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.functions.lineage import written


def running_sum(rows: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """rows with running, the sum of value up to and with each row in a total order of all rows.

    Rows are dealt by ranges of the order and sorted within them; each range has its own running sum, to which the sums of the
    ranges before it are added (one row a partition). The sorted rows are written once, as a second sort might draw other ranges. order
    must be total: rows that are equal in it come in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("value", value).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("place", F.monotonically_increasing_id()), "ordered").withColumn("range", F.shiftright("place", 33))
    sums = placed.groupBy("range").agg(F.sum("value").alias("whole"))
    before = F.coalesce(F.sum("whole").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("value").over(Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = placed.withColumn("own", own).join(F.broadcast(sums.select("range", before.alias("before"))), "range")
    return told.withColumn("running", F.col("before") + F.col("own")).drop("range", "place", "own", "before", "value")


#: Lists from which a context that is too long is trimmed, the first one first and from its end; then topics and memories down to one
#: each, then the memory, then the topic. Fixed values.
TRIMMED = ("graph_neighbors", "suggested_related_topics", "related_topics", "topic_relations", "entities", "episodes", "message_references")
KEPT_LONGEST = ("memories", "topics")


def budgeted_context(items: DataFrame, budget: int, envelope: int = 20) -> DataFrame:
    """The items (request, list, rank from 1, id, cost) of each request that stay within budget tokens, with the running cost.

    What is trimmed last comes first in one order over all requests: the first topic, the first memory, the other memories, the other
    topics, then the optional lists from the last to the first; within a list by rank. An item stays if the request's
    costs up to it, and those of the envelope, are within the budget. Lists of other names come after all of these. Requests
    without items give no rows; costs are positive.
    """
    after = [*reversed(TRIMMED)]
    step = F.when(F.col("list") == "topics", F.when(F.col("rank") == 1, 0).otherwise(3)).when(F.col("list") == "memories", F.when(F.col("rank") == 1, 1).otherwise(2))
    for k, name in enumerate(after, 4):
        step = step.when(F.col("list") == name, k)
    ordered = items.withColumn("step", step.otherwise(4 + len(after)))
    order = [F.asc("request"), F.asc("step"), F.asc("rank"), F.asc("list"), F.asc("id")]
    told = running_sum(ordered, order, F.col("cost").cast("long"))
    base = told.groupBy("request").agg(F.min(F.col("running") - F.col("cost")).alias("base"))
    spent = told.join(base, "request").withColumn("spent", F.col("running") - F.col("base"))
    return spent.where(F.col("spent") + envelope <= budget).select("request", "list", "rank", "id", "cost", "spent")


def greedy_cover(relation: DataFrame) -> DataFrame:
    """The greedy set cover of a relation (candidate, concern, score): candidate, gain and turn, from 1.

    In turn the candidate with most uncovered concerns, of those the one with the greatest score, then the least name. Candidates of
    one gain that share no concern do not change each other's gain, so a round takes all that no better one of the same gain
    shares a concern with: the same picks as one at a time. Rows with null are left out; a candidate's score is its greatest.
    """
    given = relation.where("candidate is not null and concern is not null").groupBy("candidate", "concern").agg(F.max("score").alias("score"))
    best = F.max("score").over(Window.partitionBy("candidate"))
    left = written(given.select("candidate", "concern", F.struct((-F.coalesce(best, F.lit(0.0))).alias("score"), "candidate").alias("rank")), "relation")
    picked = None
    while True:
        gains = left.groupBy("candidate").agg(F.count("*").alias("gain"))
        most = gains.agg(F.max("gain")).first()[0]
        if not most:
            break
        among = left.join(gains.where(F.col("gain") == most), "candidate")
        first = among.groupBy("concern").agg(F.min("rank").alias("first"))
        free = among.join(first, "concern").groupBy("candidate", "rank", "gain").agg(F.min(F.col("rank") == F.col("first")).alias("free")).where("free").select("candidate", "rank", "gain")
        chosen = written(free, "picks")
        picked = chosen if picked is None else picked.unionByName(chosen)
        done = left.join(chosen.select("candidate"), "candidate", "left_semi").select("concern").distinct()
        left = written(left.join(done, "concern", "left_anti"), "relation")
    if picked is None:
        return left.select("candidate", F.lit(0).cast("long").alias("gain"), F.lit(0).cast("long").alias("turn"))
    # a turn is a place among the picks, which are no more than the concerns
    return running_sum(picked, [F.desc("gain"), F.asc("rank")], F.lit(1)).select("candidate", "gain", F.col("running").alias("turn"))


def capped_greedy(rows: DataFrame, order: list[str], caps: dict[str, int], limit: int | None = None) -> DataFrame:
    """rows (with a unique id) that are taken one by one in an order, each if for every capped column fewer than its cap are taken with the same value.

    Equal to the fold over all rows, in rounds: a row whose place among the undecided rows is, for every column, within what
    is left of its value's cap is taken, whatever becomes of the rows before it; rows of a value whose cap is used up are out.
    The first undecided row is always taken, so rounds end. order names columns, ascending, and must be total; a null value is a value.
    """
    left, taken = written(rows, "undecided"), None
    while not left.isEmpty():
        sure = None
        for column, cap in caps.items():
            place = F.row_number().over(Window.partitionBy(column).orderBy(*order))
            near = left.select("id", column, *[c for c in order if c not in ("id", column)]).withColumn("place", place).where(F.col("place") <= cap)  # a value's first rows, counted before the shuffle
            if taken is not None:
                used = taken.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("used"))
                near = near.join(used, F.col(column).eqNullSafe(F.col("value")), "left").where(F.col("place") <= cap - F.coalesce("used", F.lit(0)))
            sure = near.select("id") if sure is None else sure.join(near.select("id"), "id", "left_semi")
        chosen = written(left.join(sure, "id", "left_semi"), "taken")
        taken = chosen if taken is None else taken.unionByName(chosen)
        left = left.join(chosen.select("id"), "id", "left_anti")
        for column, cap in caps.items():
            full = taken.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("used")).where(F.col("used") >= cap).select("value")
            left = left.join(full, F.col(column).eqNullSafe(F.col("value")), "left_anti")
        left = written(left, "undecided")
    out = rows.limit(0) if taken is None else taken
    return out if limit is None else out.orderBy(*order).limit(limit)


#: Relations that tell of a flow, the most telling first. Fixed value.
FLOWS = ("invoca ruta", "despacha", "llama", "valida con", "crea", "despacha evento", "implementa", "hereda")


def flow_list(nodes: DataFrame, edges: DataFrame, priority: tuple[str, ...] = FLOWS, limit: int = 6) -> DataFrame:
    """The flows that stand for a graph: place, source, relation, target (names), confidence and evidence (file:line).

    Edges of the listed relations in the order of relation, extracted ones first, then the source's degree; none from test files;
    each (source, relation, target) once, at most two a source and, where three or more relations occur, one a relation, else
    three. Further ties go to the lesser ids.
    """
    degree = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    told = edges.where(F.col("label").isin(*priority))
    kinds = told.select("label").distinct().count()  # at most as many as are listed
    named = nodes.select("id", "name", "file").join(degree, "id", "left")
    source = named.select(F.col("id").alias("source"), F.col("name").alias("from"), F.col("file").alias("from_file"), F.coalesce("degree", F.lit(0)).alias("degree"))
    met = told.join(source, "source").join(nodes.select(F.col("id").alias("target"), F.col("name").alias("to")), "target")
    path = F.translate(F.coalesce("from_file", "file", F.lit("")), "\\", "/")
    met = met.where(~path.rlike(r"(?i)(?:^|/)tests?(?:/|$)"))
    held = met.select(F.array_position(F.array(*map(F.lit, priority)), F.col("label")).alias("k"), "from", "to", "confidence", "degree", "source", "target", "file", "line")
    return _first_flows(written(held, "flows"), priority, 1 if kinds >= 3 else 3, limit)


def _first_flows(flows: DataFrame, priority: tuple[str, ...], cap: int, limit: int) -> DataFrame:
    """The greedy choice of flow_list(): two rows a source and cap a relation at most.

    A pass finds the first row left of each relation, as one row of totals; no flow is shuffled. As relations come one after
    the other, there are no more passes than rows chosen.
    """
    rank = [(F.upper(F.coalesce("confidence", F.lit(""))) != "EXTRACTED").alias("weak"), (-F.col("degree")).alias("d"), "source", "target", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line")]
    evidence = F.when(F.coalesce("file", F.lit("")) != "", F.concat_ws(":", "file", "line")).alias("evidence")
    row = F.struct(*rank, F.concat_ws("\0", "from", "to").alias("id"), "confidence", evidence, "from", "to")
    got, used, left, places = [], Counter(), flows, list(range(1, len(priority) + 1))
    while places and len(got) < limit:
        first = left.agg(*[F.min(F.when(F.col("k") == k, row)).alias(str(k)) for k in places]).first()
        while places and len(got) < limit:
            k = places[0]
            m = first[str(k)]
            if m is not None:
                if used[m["from"]] >= 2:
                    break  # taken up within this pass
                got.append((len(got) + 1, m["from"], priority[k - 1], m["to"], m["confidence"], m["evidence"]))
                used[m["from"]] += 1
                left = left.where(~((F.col("k") == k) & F.col("from").eqNullSafe(m["from"]) & F.col("to").eqNullSafe(m["to"])))
                if used[m["from"]] == 2:
                    left = left.where(~F.col("from").eqNullSafe(m["from"]))
                if sum(g[2] == priority[k - 1] for g in got) < cap:
                    break
            places.pop(0)
    return flows.sparkSession.createDataFrame(got, "place int, source string, relation string, target string, confidence string, evidence string")
