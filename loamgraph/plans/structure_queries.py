"""Queries of communities, text references, budgets, covers, learned ranking, histories, versions and queues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import text as X
from loamgraph.functions.lineage import scratch
from loamgraph.operators import communities as C
from loamgraph.operators import graph as G
from loamgraph.operators import ranking, references, selection, snippets
from loamgraph.plans.graph_queries import E, N
from loamgraph.sources import model as M
from loamgraph.sources import snapshots
from loamgraph.streaming import history
from loamgraph.streaming.queue import Queue

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def graph_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by modularity of all pairs of files, over all labels but containment."""
    return C.louvain(G.file_pairs(M.nodes(spark, sf_dir), M.edges(spark, sf_dir).where("label <> 'contains'")))


@query()
def src_text_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three words of the documents are used, each document a symbol of its source's file; some lines open or close a comment."""
    d = M.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit(".py")).alias("file"), F.split("text", "\n").alias("ls"))
    starts = selection.running_sum(d.select("doc_id", "file", F.size("ls").alias("n")), [F.asc("file"), F.asc("doc_id")], F.col("n").cast("long"))
    first = starts.groupBy("file").agg(F.min(F.col("running") - F.col("n")).alias("base"))
    spans = starts.join(first, "file").select("doc_id", "file", (F.col("running") - F.col("n") - F.col("base") + 1).alias("line"), (F.col("running") - F.col("base")).alias("end_line"))
    lines = d.select("doc_id", F.posexplode("ls").alias("i", "text")).join(spans, "doc_id").select("file", (F.col("line") + F.col("i")).alias("line"), "text")
    kind = F.pmod(F.crc32(F.encode("text", "UTF-8")), F.lit(11))
    lines = lines.withColumn("text", F.when(kind == 3, F.concat(F.lit("/* "), "text")).when(kind == 7, F.concat("text", F.lit(" */"))).otherwise(F.col("text")))
    symbols = spans.select("file", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "line", "end_line")
    none = spark.createDataFrame([], "file string, line long, owner string")
    return references.text_references(lines, symbols, ["the", "die", "les"], none, none, F.col("file").endswith("en.py")).select("owner", "file", "line", "kind", "tests", "near")


@query(f"WITH o AS ({M.OBSERVATIONS_SQL}) SELECT id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY ts, id) AS BIGINT) AS running FROM o")
def hist_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running total of all events' values in order of time."""
    o = M.observations(spark, sf_dir)
    return selection.running_sum(o.select("id", "ts", "value"), [F.asc("ts"), F.asc("id")], F.round(F.col("value") * 100).cast("long")).select("id", "running")


CONTEXT_SQL = """WITH i AS (
  SELECT doc_id % 7 AS request, 'memories' AS list, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY n_chars, doc_id) AS rank, 'd' || doc_id AS id, greatest(1, strlen(text) // 4) AS cost FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT conv_id % 7, CASE turn % 3 WHEN 0 THEN 'topics' WHEN 1 THEN 'episodes' ELSE 'graph_neighbors' END,
    row_number() OVER (PARTITION BY conv_id % 7, CASE turn % 3 WHEN 0 THEN 'topics' WHEN 1 THEN 'episodes' ELSE 'graph_neighbors' END ORDER BY conv_id, turn), 'm' || conv_id || '-' || turn, greatest(1, strlen(coalesce(text, '')) // 4) FROM conversations
), s AS (SELECT *, CASE WHEN list = 'topics' THEN CASE WHEN rank = 1 THEN 0 ELSE 3 END WHEN list = 'memories' THEN CASE WHEN rank = 1 THEN 1 ELSE 2 END WHEN list = 'episodes' THEN 5 ELSE 10 END AS step FROM i),
r AS (SELECT request, list, rank, id, cost, sum(cost) OVER (PARTITION BY request ORDER BY step, rank, list, id) AS spent FROM s)
SELECT request, list, rank, id, CAST(cost AS BIGINT) AS cost, CAST(spent AS BIGINT) AS spent FROM r WHERE spent + 20 <= 20000"""


@query(CONTEXT_SQL)
def doc_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven contexts out of all documents and messages, each within one budget over its lists."""
    from pyspark.sql import Window

    d = M.table(spark, sf_dir, "documents").where("text is not null").select((F.col("doc_id") % 7).alias("request"), F.lit("memories").alias("list"), F.struct("n_chars", "doc_id").alias("at"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), X.token_estimate(F.col("text")).alias("cost"))
    name = F.when(F.col("turn") % 3 == 0, "topics").when(F.col("turn") % 3 == 1, "episodes").otherwise("graph_neighbors")
    c = M.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 7).alias("request"), name.alias("list"), F.struct(F.col("conv_id").alias("n_chars"), F.col("turn").alias("doc_id")).alias("at"), F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), X.token_estimate(F.col("text")).alias("cost"))
    ranked = d.unionByName(c).withColumn("rank", F.row_number().over(Window.partitionBy("request", "list").orderBy("at")).cast("long")).drop("at")
    return selection.budgeted_context(ranked, 20_000)


@query("""WITH RECURSIVE rel AS (SELECT DISTINCT l_suppkey AS candidate, l_partkey % 400 AS concern, s_acctbal AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
pick(turn, candidate, gain, left_over) AS (
  SELECT 0, NULL::BIGINT, 0::BIGINT, (SELECT list(DISTINCT concern) FROM rel)
  UNION ALL
  SELECT turn + 1, best.candidate, best.gain, list_filter(left_over, lambda c: NOT list_contains(best.own, c)) FROM (
    SELECT p.turn, p.left_over, arg_min({'candidate': c.candidate, 'gain': c.gain, 'own': c.own}, (-c.gain, -c.score, c.candidate)) AS best
    FROM pick p, LATERAL (SELECT candidate, any_value(score) AS score, count(*) AS gain, list(concern) AS own FROM rel WHERE list_contains(p.left_over, concern) GROUP BY candidate) c
    WHERE len(p.left_over) > 0 GROUP BY ALL)
) SELECT candidate, gain, CAST(turn AS BIGINT) AS turn FROM pick WHERE turn > 0""")
def graph_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers that together supply parts of all 400 classes, greedily."""
    li = M.table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 400).alias("concern")).distinct()
    s = M.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("score"))
    return selection.greedy_cover(li.join(s, "l_suppkey").select(F.col("l_suppkey").alias("candidate"), "concern", "score"))


def _ranking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = M.table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("request"), F.col("l_linenumber").cast("long").alias("candidate"), (F.col("l_returnflag") == "R").alias("relevant"), (F.col("l_quantity") / 50).alias("quantity"),
        (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"), (F.col("l_linestatus") == "O").cast("double").alias("open"),
    )


@query()
def eval_learned_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by which returned lines of an order rank before its others, fitted on all orders."""
    found = ranking.fit_weights(_ranking_rows(spark, sf_dir), ["quantity", "discount", "tax", "open"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in found.items()], "feature string, weight double")


@query("""WITH s AS (SELECT l_orderkey AS request, CAST(l_linenumber AS BIGINT) AS candidate, CAST(round(l_quantity / 50 * 300 + l_discount * 10 * 20 + l_tax * 10 * -70) AS BIGINT) AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, candidate) AS rank FROM s) SELECT request, candidate, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def eval_weighted_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_by_weights(_ranking_rows(spark, sf_dir), {"quantity": 300, "discount": 20, "tax": -70}, 3)


@query("""SELECT 'c' || conv_id AS session, role, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS digest, count(*) AS messages, max(CASE WHEN conv_id % 4 = 0 THEN CAST(turn AS DOUBLE) + 1600000000 END) AS last
FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1, 2, 3""")
def msg_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written as histories of four shapes and read back as messages."""
    c = M.table(spark, sf_dir, "conversations").withColumn("session", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    k = F.col("conv_id") % 4
    line = F.when(k == 0, F.to_json(F.struct(F.col("session").alias("sessionId"), "role", F.col("text").alias("content"), ((F.col("turn") + 1_600_000_000) * 1000).alias("timestamp"))))
    block = F.array(F.struct(F.lit("text").alias("type"), "text"))
    line = line.when(k == 1, F.to_json(F.struct(F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("event").alias("type"), F.col("session").alias("session_id"), F.struct("role", block.alias("content")).alias("message"))))
    line = line.when(k == 2, F.to_json(F.struct(F.col("session").alias("conversation_id"), F.struct(F.struct(F.col("role").alias("role")).alias("author"), "text").alias("payload"))))
    single = c.where(k != 3).select("session", F.col("turn").alias("line"), line.alias("value"))
    whole = c.where(k == 3).groupBy("session").agg(F.to_json(F.struct(F.collect_list(F.struct("role", "text")).alias("messages"))).alias("value")).select("session", F.lit(0).cast("long").alias("line"), "value")
    lines = single.unionByName(whole).select(F.concat(F.lit("logs/"), "session", F.lit(".jsonl")).alias("source"), "line", "value")
    return history.history_messages(lines).where("role <> 'tool'").groupBy("session", "role", F.md5("content").alias("digest")).agg(F.count("*").alias("messages"), F.max("occurred_at").alias("last"))


@query(f"""WITH {N}, {E} SELECT 'nodes' AS "table", count(*) AS rows, 'ok' AS state FROM n UNION ALL SELECT 'edges', count(*), 'ok' FROM e""")
def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph committed as a version, then a part of it as a second one; the first is verified and made current again."""
    root = scratch(spark, "graph")
    tables = {"nodes": M.nodes(spark, sf_dir), "edges": M.edges(spark, sf_dir)}
    first = snapshots.commit(spark, root, tables)
    snapshots.commit(spark, root, {"nodes": tables["nodes"].where("kind = 'part'")})
    snapshots.restore(spark, root, first)
    states = snapshots.verify(spark, root, first).groupBy("table").agg(F.max("state").alias("state"))
    counts = [snapshots.read(spark, root, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows") for t in tables]
    return counts[0].unionByName(counts[1]).join(states, "table")


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT 'u' || lpad(user_id::VARCHAR, 9, '0') AS item, row_number() OVER (ORDER BY user_id) AS r FROM u), n AS (SELECT (count(*) + 2) // 3 AS n FROM k)
SELECT item, CASE WHEN r <= n AND r % 2 = 0 THEN 'done' WHEN r <= n THEN 'queued' ELSE 'leased' END AS status, CAST(CASE WHEN r <= n THEN 1 WHEN r <= 2 * n THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN r > n THEN 'c' END AS worker FROM k, n""")
def hist_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users as work: one worker does or fails its third, the second is lost, a third one takes over what it held and the rest."""
    from pyspark.sql import Window

    items = M.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("item")).distinct()
    q = Queue(spark, scratch(spark, "queue"), lease=100, back_off=1000)
    third = -(-q.put(items, 0) // 3)
    mine = q.claim("a", 1, third)
    q.claim("b", 2, third)
    placed = mine.withColumn("r", F.row_number().over(Window.orderBy("item")))  # what one worker holds
    q.finish("a", placed.where("r % 2 = 0"), 3)
    q.finish("a", placed.where("r % 2 = 1"), 4, error="no answer")
    q.claim("c", 200, 2 * third)
    return q.state(201).select("item", "status", "attempts", "worker")


@query(f"""WITH {N}, {E}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1),
c AS (
  SELECT a.name AS source, e.label AS relation, b.name AS target, e.confidence, CASE WHEN coalesce(e.file, '') <> '' THEN e.file || ':' || e.line END AS evidence,
    row_number() OVER (PARTITION BY e.label ORDER BY (e.confidence <> 'EXTRACTED'), d.degree DESC, e.source, e.target, coalesce(e.file, ''), coalesce(e.line, 0)) AS k,
    CASE e.label WHEN 'creates' THEN 1 WHEN 'uses' THEN 2 ELSE 3 END AS place
  FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target JOIN d ON d.id = e.source WHERE e.label IN ('creates', 'uses', 'supplies') AND NOT regexp_matches(a.file, '(?i)(?:^|/)tests?(?:/|$)')
) SELECT CAST(place AS INTEGER) AS place, source, relation, target, confidence, evidence FROM c WHERE k = 1""")
def graph_flow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows that stand for the whole graph, under caps a source and a relation."""
    return selection.flow_list(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), (M.CREATES, M.USES, M.SUPPLIES))


SNIPPET_TERMS = ["ation", "ung", "the ", "license", "que"]


@query("""WITH t AS (SELECT unnest(['ation', 'ung', 'the ', 'license', 'que']) AS term, unnest(range(5)) AS k), d AS (SELECT doc_id, text, lower(text) AS low, length(text) AS n FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, n, strpos(low, term) - 1 AS pos, k FROM d, t WHERE contains(low, term)),
w AS (SELECT *, greatest(0, pos - 100) AS s, least(n, pos + 230) AS e FROM a),
m AS (SELECT *, CASE WHEN max(e) OVER v IS NULL OR s > max(e) OVER v + 40 THEN 1 ELSE 0 END AS new FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos, k) AS island FROM m),
b AS (SELECT doc_id, island, min(s) AS s, least(max(e), min(s) + 640) AS e, min(s) + 640 AS edge FROM i GROUP BY 1, 2),
g AS (SELECT b.doc_id, b.s, b.e, bit_or(1 << k) FILTER (i.pos < b.e) AS mask FROM b JOIN i ON i.doc_id = b.doc_id AND i.island = b.island GROUP BY 1, 2, 3),
c AS (
  SELECT doc_id, mask, e - s AS size, [{'s': s, 'e': e}] AS spans FROM g
  UNION ALL SELECT x.doc_id, x.mask | y.mask, x.e - x.s + y.e - y.s, [{'s': x.s, 'e': x.e}, {'s': y.s, 'e': y.e}] FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.s < y.s
  UNION ALL SELECT x.doc_id, x.mask | y.mask | z.mask, x.e - x.s + y.e - y.s + z.e - z.s, [{'s': x.s, 'e': x.e}, {'s': y.s, 'e': y.e}, {'s': z.s, 'e': z.e}] FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.s < y.s JOIN g z ON z.doc_id = y.doc_id AND y.s < z.s
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bit_count(mask) DESC, size, spans) AS k FROM c WHERE size <= 640)
SELECT d.doc_id, coalesce(array_to_string(list_transform(r.spans, lambda x: x.s || '-' || x.e), ','), '0-' || least(d.n, 230)) AS spans FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND r.k = 1""")
def doc_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the windows that show most of five terms within 640 characters."""
    d = M.table(spark, sf_dir, "documents").where("text is not null")
    spans = F.transform(snippets.best_spans(F.col("text"), SNIPPET_TERMS), lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string")))
    return d.select("doc_id", F.array_join(spans, ",").alias("spans"))
