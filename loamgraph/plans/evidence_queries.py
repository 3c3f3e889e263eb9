"""Queries of bounded results and of resolution beyond names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import paths
from loamgraph.functions import text as X
from loamgraph.operators import bounded as B
from loamgraph.operators import graph as G
from loamgraph.operators import impact as P
from loamgraph.operators import resolve as V
from loamgraph.operators import retrieval as R
from loamgraph.operators import traverse as T
from loamgraph.plans.graph_queries import CHANGED, E, N, _rounds_sql
from loamgraph.plans.source_queries import SPREAD_SQL, TOKEN_SQL
from loamgraph.plans.text_queries import FOLDED_SQL, MEM, MSG, OBS
from loamgraph.sources import model as M

QUERIES: dict = {}
SQL: dict[str, str] = {}
DEGREES = "d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1)"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- bounded results ---------------------------------------------------------------------------------------


@query(f"""WITH {N}, s AS (SELECT kind, list_has_any(list_concat(string_split(lower(file), '/')[:-2], string_split_regex(lower(container), '[.:\\\\]+')), ['customer', 'suppliers', 'tests']) AS inside FROM n)
SELECT kind, inside, count(*) AS nodes FROM s GROUP BY ALL""")
def graph_named_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = B.in_named_scope(F.col("file"), F.col("container"), ["Customer", "suppliers", "tests"])
    return M.nodes(spark, sf_dir).select("kind", inside.alias("inside")).groupBy("kind", "inside").agg(F.count("*").alias("nodes"))


@query("SELECT doc_id, source, CASE WHEN text = source OR text = CAST(doc_id AS VARCHAR) THEN NULL ELSE substr(text, 1, 240) END AS text FROM documents")
def doc_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.compact(M.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id", "source"], "text")


@query(f"""WITH {N}, {E}, f AS (SELECT id FROM n ORDER BY kind, id LIMIT 300), c AS (SELECT (SELECT count(*) FROM n) AS a, (SELECT count(*) FROM e WHERE source IN (SELECT id FROM f) AND target IN (SELECT id FROM f)) AS l)
SELECT least(300, a) AS nodes, a - least(300, a) AS nodes_truncated, least(600, l) AS links, l - least(600, l) AS links_truncated FROM c""")
def graph_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bounded(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), ["kind", "id"], 300)


@query(f"""WITH {N}, {E}, {DEGREES}, t AS (SELECT n.*, degree FROM n JOIN d USING (id) ORDER BY degree DESC, id LIMIT 60),
k AS (SELECT id FROM t UNION SELECT 'nation:' || string_split(file, '/')[3] FROM t WHERE kind IN ('customer', 'supplier')), m AS (SELECT * FROM n WHERE id IN (SELECT id FROM k))
SELECT 'node' AS what, kind AS of, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'link', label, count(*) FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) GROUP BY 2""")
def graph_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = M.edges(spark, sf_dir)
    parent = F.when(F.col("kind").isin("customer", "supplier"), F.concat(F.lit("nation:"), F.get(F.split("file", "/"), 2)))
    kept, links = B.map_view(M.nodes(spark, sf_dir), edges, G.degree(edges), parent, 60)
    counts = kept.groupBy(F.col("kind").alias("of")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "of", "n")
    return counts.unionByName(links.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n")).select(F.lit("link").alias("what"), "of", "n"))


@query("""WITH x AS (SELECT doc_id // 2 AS topic, source AS agent FROM documents), t AS (SELECT DISTINCT topic FROM x)
SELECT topic FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.topic = t.topic AND lower(coalesce(agent, '')) NOT IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9', 'src10'))""")
def doc_visible_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = M.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("topic"), F.col("source").alias("agent"))
    return B.visible_topics(episodes.select("topic").distinct(), episodes, ["SRC1", *[f"src{i}" for i in range(2, 11)]], private=True)


@query(f"""WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '  <environment_context> ' WHEN 1 THEN 'Shared memory says message_id 7: ' WHEN 2 THEN 'please retrieve from loamgraph shared memory: ' WHEN 3 THEN '<instructions> see agents.md ' ELSE '' END || text AS t,
  CASE doc_id % 10 WHEN 7 THEN 'conversation' WHEN 8 THEN ' Bootstrap' END AS origin, doc_id % 25 = 0 AS evaluation FROM documents), p AS (SELECT *, substr(ltrim(lower(t)), 1, 8000) AS s, lower(trim(coalesce(origin, ''))) AS o FROM c),
f AS (SELECT *, {FOLDED_SQL.format('s')} AS low FROM p)
SELECT doc_id, evaluation OR o IN ('bootstrap', 'evaluation', 'memory_retrieval_request', 'memory_retrieval_answer') OR (o = '' AND (starts_with(s, '# agents.md instructions for ') OR starts_with(s, '<environment_context>') OR (starts_with(s, '<instructions>') AND contains(s, 'agents.md'))
  OR ((contains(low, 'memoria compartida') OR contains(low, 'shared memory')) AND (contains(low, 'message_id') OR (contains(low, 'loamgraph') AND (contains(low, 'consulta') OR contains(low, 'consult') OR contains(low, 'recupera') OR contains(low, 'retrieve'))))))) AS injected FROM f""")
def doc_injected_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages, most of them with a captured beginning before them."""
    k = F.col("doc_id") % 6
    start = F.when(k == 0, "  <environment_context> ").when(k == 1, "Shared memory says message_id 7: ").when(k == 2, "please retrieve from loamgraph shared memory: ").when(k == 3, "<instructions> see agents.md ").otherwise("")
    origin = F.when(F.col("doc_id") % 10 == 7, "conversation").when(F.col("doc_id") % 10 == 8, " Bootstrap")
    return M.table(spark, sf_dir, "documents").select("doc_id", B.injected_context(F.concat(start, "text"), origin, F.col("doc_id") % 25 == 0).alias("injected"))


@query(f"""WITH {N}, r AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY file, line, id) > 1 AS again, file, line FROM n WHERE kind = 'part')
SELECT id, name, row_number() OVER (ORDER BY again, file, line, id) AS place FROM r ORDER BY again, file, line, id LIMIT 80""")
def graph_one_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.one_per_name(M.nodes(spark, sf_dir).where("kind = 'part'"), "name", ["file", "line", "id"], 80).select("id", "name", F.col("place").cast("long").alias("place"))


@query("""WITH t AS (SELECT source || ':' || lang AS topic, count(*) AS episodes FROM documents GROUP BY 1), p AS (SELECT *, (SELECT count(*) FROM t) AS n FROM t ORDER BY episodes DESC, topic LIMIT 7 OFFSET 5)
SELECT topic, episodes, CASE WHEN n > 12 THEN 12 END AS next_offset FROM p""")
def doc_topic_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = M.table(spark, sf_dir, "documents").groupBy(F.concat_ws(":", "source", "lang").alias("topic")).agg(F.count("*").alias("episodes"))
    return B.page_with_next(topics, [F.desc("episodes"), "topic"], 5, 7)


@query("""WITH s AS (SELECT 'store' || (doc_id % 3) AS store, doc_id AS id, length(text) - length(replace(lower(text), 'a', '')) AS score, n_chars AS "at" FROM documents) SELECT * FROM s ORDER BY score DESC, "at" DESC, store, id LIMIT 25""")
def doc_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.length("text") - F.length(F.replace(F.lower("text"), F.lit("a"), F.lit("")))).cast("long")
    d = M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), score.alias("score"), F.col("n_chars").alias("at"))
    return B.federated({f"store{k}": d.where(F.col("id") % 3 == k) for k in range(3)}, 25)


@query(f"""WITH {MEM}, p AS (SELECT id, agent, digest FROM m WHERE id % 3 <> 0), s AS (SELECT id, 'other' AS agent, digest FROM m WHERE id % 2 = 0)
SELECT agent = 'other' AS added, count(*) AS memories FROM (SELECT * FROM p UNION ALL SELECT * FROM s WHERE id NOT IN (SELECT id FROM p)) GROUP BY 1""")
def doc_merge_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.memories(spark, sf_dir).select("id", "agent", "digest")
    merged = B.merge_store(m.where("id % 3 <> 0"), m.where("id % 2 = 0").withColumn("agent", F.lit("other")))
    return merged.groupBy((F.col("agent") == "other").alias("added")).agg(F.count("*").alias("memories"))


@query(f"""WITH {MEM}, l AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'old' ELSE digest END AS done FROM m WHERE id % 4 < 2)
SELECT action, count(*) AS memories FROM (SELECT CASE WHEN done IS NULL THEN 'copied' WHEN done = digest THEN 'skipped' ELSE 'conflict' END AS action FROM m LEFT JOIN l USING (id)) GROUP BY 1""")
def doc_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.memories(spark, sf_dir).select("id", "digest")
    ledger = m.where("id % 4 < 2").withColumn("digest", F.when(F.col("id") % 10 == 0, "old").otherwise(F.col("digest")))
    return B.consolidate(m, ledger).groupBy("action").agg(F.count("*").alias("memories"))


@query("""WITH f AS (SELECT doc_id, md5(text) AS digest FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE digest END AS digest, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 2 END AS version FROM f WHERE doc_id % 3 <> 0)
SELECT reused, count(*) AS files FROM (SELECT o.doc_id IS NOT NULL AS reused FROM f LEFT JOIN o ON f.doc_id = o.doc_id AND f.digest = o.digest AND version = 2) GROUP BY 1""")
def src_structural_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("digest"))
    old = new.where("path % 3 <> 0").select("path", F.when(F.col("path") % 5 == 0, "changed").otherwise(F.col("digest")).alias("digest"), F.when(F.col("path") % 7 == 0, 1).otherwise(2).alias("version"))
    return B.reused_facts(old, new, 2).groupBy("reused").agg(F.count("*").alias("files"))


@query("SELECT source, greatest(0, CAST(sum(strlen(text)) AS BIGINT) // 4 - CAST(sum(least(900, strlen(text))) AS BIGINT) // 4) AS avoided FROM documents GROUP BY 1")
def doc_tokens_avoided(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text")
    sums = M.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(n).alias("files"), F.sum(F.least(F.lit(900), n)).alias("payload"))
    return sums.select("source", B.tokens_avoided(F.col("files"), F.col("payload")).alias("avoided"))


@query(f"""WITH {MSG}, k AS ({M.MEMORIES_SQL}), b AS (SELECT DISTINCT agent AS bundle, session FROM k), c AS (SELECT DISTINCT agent AS bundle, session, 1 AS seq FROM k WHERE agent < 'src5' AND session < 20),
x AS (SELECT session, seq, greatest(1, strlen(content) // 4) AS cost FROM m), w AS (SELECT bundle, sum(cost) AS whole FROM b LEFT JOIN x USING (session) GROUP BY 1), z AS (SELECT bundle, sum(cost) AS cited FROM c JOIN x USING (session, seq) GROUP BY 1)
SELECT bundle, CAST(coalesce(CASE WHEN bundle IN (SELECT bundle FROM c) THEN cited ELSE whole END, 0) AS BIGINT) AS tokens FROM w LEFT JOIN z USING (bundle)""")
def doc_source_history_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories by agent; the agents below src5 cite the first answers of sessions below 20."""
    b = M.memories(spark, sf_dir).select(F.col("agent").alias("bundle"), "session").distinct()
    cites = b.where("bundle < 'src5' and session < 20").withColumn("seq", F.lit(1).cast("long"))
    return B.source_history_tokens(b, cites, M.messages(spark, sf_dir))


@query(f"""WITH {MSG}, p AS (SELECT session, seq, list_distinct({TOKEN_SQL.format('content')}) AS t, list_distinct({TOKEN_SQL.format("coalesce(lag(content) OVER (PARTITION BY session ORDER BY seq), '')")}) AS q FROM m)
SELECT session, seq, len(list_intersect(q, t)) AS overlap, round(least(0.08::DOUBLE, len(list_intersect(q, t))::DOUBLE / greatest(1, len(q)) * 0.12::DOUBLE), 6) AS semantic_bonus,
  CASE WHEN len(list_intersect(list_filter(q, x -> length(x) >= 7), t)) > 0 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS identifier_bonus FROM p""".replace("x -> length(x) >= 7", "lambda x: length(x) >= 7"))
def msg_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message against the one before it; its long words are the identifiers."""
    from pyspark.sql import Window

    before = F.lag("content").over(Window.partitionBy("session").orderBy("seq"))
    t = M.messages(spark, sf_dir).withColumn("before", before).select("session", "seq", F.array_distinct(X.tokens(F.col("content"))).alias("t"), F.array_distinct(X.tokens(F.col("before"))).alias("q"))
    r = B.relevance(F.col("q"), F.col("t"), F.filter("q", lambda x: F.length(x) >= 7))
    return t.select("session", "seq", r.alias("r")).select("session", "seq", F.col("r.overlap").cast("long").alias("overlap"), "r.semantic_bonus", "r.identifier_bonus")


@query(f"WITH {N} SELECT id, name FROM n WHERE contains(lower(name), 'ring') OR contains(lower(coalesce(container, '')), 'ring')")
def graph_plain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.plain_query(M.nodes(spark, sf_dir), "RING").select("id", "name")


@query(f"""WITH {N} SELECT string_split(file, '/')[2] AS project, round((CASE WHEN bool_or(kind = 'part') THEN 1 ELSE 0 END + CASE WHEN bool_or(container = 'world') THEN 1 ELSE 0 END + CASE WHEN bool_or(starts_with(file, 'tests/')) THEN 1 ELSE 0 END
  + CASE WHEN count(*) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT container) > 2 THEN 1 ELSE 0 END + CASE WHEN bool_or(contains(name, 'red')) THEN 1 ELSE 0 END) / 6.0::DOUBLE, 4) AS quality FROM n GROUP BY 1""")
def graph_overview_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = M.nodes(spark, sf_dir).groupBy(F.get(F.split("file", "/"), 1).alias("project")).agg(
        F.bool_or(F.col("kind") == "part").alias("a"), F.bool_or(F.col("container") == "world").alias("b"), F.bool_or(F.col("file").startswith("tests/")).alias("c"),
        (F.count("*") > 20).alias("d"), (F.count_distinct("container") > 2).alias("e"), F.bool_or(F.col("name").contains("red")).alias("f"),
    )
    return g.select("project", B.overview_quality([F.col(c) for c in "abcdef"]).alias("quality"))


@query(f"WITH {OBS} SELECT id, session, action FROM o WHERE session IN (1, 2, 3, 5, 8) ORDER BY ts DESC, id DESC LIMIT 40")
def hist_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.observations(spark, sf_dir).where(F.col("session").isin(1, 2, 3, 5, 8)).orderBy(F.desc("ts"), F.desc("id")).limit(40).select("id", "session", "action")


@query("""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents), k AS (SELECT unnest(['the', 'der', 'license', 'e.g', '$1']) AS name),
h AS (SELECT name, file, line, row_number() OVER (PARTITION BY name ORDER BY file, line) AS place FROM l, k WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])' || regexp_escape(name) || '($|[^A-Za-z0-9_])')) SELECT name, file, line FROM h WHERE place <= 3""")
def src_identifier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.identifier_hits_in(M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text"), ["the", "der", "license", "e.g", "$1"])


@query(f"""WITH {MSG}, k AS ({M.MEMORIES_SQL}), a AS (SELECT agent, count(DISTINCT session) AS sessions, count(*) AS messages, 0 AS memories FROM m GROUP BY 1 UNION ALL SELECT agent, count(DISTINCT session), 0, count(*) FROM k GROUP BY 1)
SELECT agent, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(memories) AS BIGINT) AS memories FROM a GROUP BY 1""")
def doc_registered_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents across two stores: one of messages, one of memories."""
    zero = F.lit(0).cast("long")
    m = M.messages(spark, sf_dir).groupBy("agent").agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("messages")).withColumn("memories", zero)
    k = M.memories(spark, sf_dir).groupBy("agent").agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("memories")).withColumn("messages", zero)
    return m.unionByName(k).groupBy("agent").agg(*[F.sum(c).alias(c) for c in ("sessions", "messages", "memories")])


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag <> 'A'), e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linestatus = 'O'),
c AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM f JOIN e USING (o, p)) AS "right"), m AS (SELECT round("right" / found, 6) AS "precision", round("right" / expected, 6) AS recall FROM c)
SELECT 'precision' AS metric, "precision" AS value, 0.45::DOUBLE AS threshold, "precision" >= 0.45 AS passed FROM m UNION ALL SELECT 'recall', recall, 0.95::DOUBLE, recall >= 0.95 FROM m""")
def eval_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = M.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), "l_returnflag", "l_linestatus")
    return B.guardrails(R.truth_f1(li.where("l_returnflag <> 'A'"), li.where("l_linestatus = 'O'"), ["o", "p"]), {"precision": 0.45, "recall": 0.95})


# --- resolution --------------------------------------------------------------------------------------------

SPANS_SQL = """s AS (SELECT s_nationkey AS file, s_suppkey AS id, s_suppkey AS start, s_suppkey + 10 + s_suppkey % 7 AS "end" FROM supplier)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("start"), (F.col("s_suppkey") + 10 + F.col("s_suppkey") % 7).alias("end"))


@query(f"""WITH {SPANS_SQL}, c AS (SELECT c_custkey AS comment_id, c_nationkey AS file, c_custkey % 110 AS line, c_custkey % 110 + c_custkey % 3 AS end_line FROM customer),
i AS (SELECT comment_id, id, "end", row_number() OVER (PARTITION BY comment_id ORDER BY "end" - start, id) AS r FROM c JOIN s USING (file) WHERE line BETWEEN start AND "end"),
b AS (SELECT comment_id, id, start, row_number() OVER (PARTITION BY comment_id ORDER BY start, id) AS r FROM c JOIN s USING (file) WHERE start > end_line AND start <= end_line + 3)
SELECT c.comment_id, coalesce(CASE WHEN b.id IS NOT NULL AND (i.id IS NULL OR b.start <= i."end") THEN b.id ELSE i.id END, -1) AS owner FROM c LEFT JOIN i ON i.comment_id = c.comment_id AND i.r = 1 LEFT JOIN b ON b.comment_id = c.comment_id AND b.r = 1""")
def graph_comment_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    comments = M.table(spark, sf_dir, "customer").select(k.alias("comment_id"), F.col("c_nationkey").alias("file"), (k % 110).alias("line"), (k % 110 + k % 3).alias("end_line"))
    return V.comment_owners(comments, _spans(spark, sf_dir)).select("comment_id", F.coalesce("owner", F.lit(-1)).alias("owner"))


@query("""WITH s AS (SELECT s_nationkey AS file, s_suppkey AS id, s_suppkey AS start, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey + s_suppkey % 7 END AS "end" FROM supplier), p AS (SELECT c_custkey AS point_id, c_nationkey AS file, c_custkey % 110 AS line FROM customer),
m AS (SELECT point_id, id, start, "end" = 0 OR "end" >= line AS open FROM p JOIN s USING (file) WHERE start <= line), b AS (SELECT point_id, arg_max(id, (start, id)) FILTER (open) AS i, arg_max(id, (start, id)) AS a FROM m GROUP BY 1)
SELECT point_id, coalesce(i, a, -1) AS id, i IS NOT NULL AS inside FROM p LEFT JOIN b USING (point_id)""")
def graph_holding_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = M.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), k.alias("id"), k.alias("start"), F.when(k % 5 == 0, 0).otherwise(k + k % 7).alias("end"))
    p = M.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_nationkey").alias("file"), (F.col("c_custkey") % 110).alias("line"))
    return V.holding(p, s).select("point_id", F.coalesce("id", F.lit(-1)).alias("id"), "inside")


@query("""WITH c AS (SELECT o_orderkey AS call_id, 'src/' || (o_orderkey % 40) AS file, o_orderkey % 90 AS name FROM orders), s AS (SELECT p_partkey AS id, p_partkey % 90 AS name, p_brand AS module, 'src/' || p_size AS target_file FROM part),
i AS (SELECT DISTINCT o_orderkey AS call_id, 'Brand#' || (1 + o_orderkey % 5) || (1 + o_custkey % 5) AS module FROM orders),
m AS (SELECT c.call_id, c.file, s.id, s.target_file, i.call_id IS NOT NULL AS wanted, bool_or(c.file = s.target_file) OVER (PARTITION BY c.call_id) AS l, bool_or(i.call_id IS NOT NULL) OVER (PARTITION BY c.call_id) AS w FROM c JOIN s USING (name) LEFT JOIN i ON i.call_id = c.call_id AND i.module = s.module)
SELECT call_id, id FROM m WHERE CASE WHEN l THEN file = target_file WHEN w THEN wanted ELSE true END""")
def graph_import_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = M.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    calls = o.select(k.alias("call_id"), F.concat(F.lit("src/"), (k % 40).cast("string")).alias("file"), (k % 90).alias("name"))
    s = M.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 90).alias("name"), F.col("p_brand").alias("module"), F.concat(F.lit("src/"), F.col("p_size").cast("string")).alias("target_file"))
    imports = o.select(k.alias("call_id"), F.concat(F.lit("Brand#"), (1 + k % 5).cast("string"), (1 + F.col("o_custkey") % 5).cast("string")).alias("module"))
    return V.imported_candidates(calls, s, imports)


@query("""WITH p AS (SELECT 'part:' || p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'interface' ELSE 'class' END AS kind, p_brand || p_size AS file, 'lib::' || lead(p_name) OVER (ORDER BY p_partkey) AS written FROM part),
m AS (SELECT c.id AS source, c.written, s.id AS target, s.kind, CASE WHEN c.file = s.file THEN 4 ELSE 0 END AS score FROM p c JOIN p s ON s.name = string_split(c.written, '::')[-1] AND s.id <> c.id),
t AS (SELECT *, count(*) OVER (PARTITION BY source, written) AS ties FROM (SELECT *, rank() OVER (PARTITION BY source, written ORDER BY score DESC) AS r FROM m) WHERE r = 1)
SELECT source, target, CASE WHEN kind = 'interface' THEN 'implements' ELSE 'inherits' END AS label, CASE WHEN ties > 1 THEN 'AMBIGUOUS' WHEN score >= 2 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence FROM t WHERE ties <= 4""")
def graph_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's base is written with the name of the part after it."""
    p = M.table(spark, sf_dir, "part")
    symbols = p.select(M.key("part", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "interface").otherwise("class").alias("kind"), F.concat("p_brand", F.col("p_size").cast("string")).alias("file"), "p_partkey")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat(F.lit("lib::"), "p_name").alias("written"))
    bases = symbols.join(after, "p_partkey").select(F.col("id").alias("child"), "written", "file")
    return V.inheritance(bases, symbols.drop("p_partkey"))


CLOSURE_SQL = """l AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0),
r AS (SELECT child AS id, parent AS ancestor, 1 AS level FROM l UNION ALL SELECT r.id, l.parent, r.level + 1 FROM r JOIN l ON l.child = r.ancestor WHERE r.level < 8), k AS (SELECT id, ancestor, min(level) AS level FROM r WHERE id <> ancestor GROUP BY 1, 2)"""


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.table(spark, sf_dir, "part").where("p_partkey > 0")
    return T.ancestry(p.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent")))


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, m AS (SELECT p_partkey AS id, p_partkey AS type, string_split(p_name, ' ')[2] AS name, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS arity FROM part),
x AS (SELECT a.id AS source, b.id AS target, k.level FROM m a JOIN k ON k.id = a.type JOIN m b ON b.type = k.ancestor AND b.name = a.name WHERE a.arity IS NULL OR b.arity IS NULL OR a.arity = b.arity)
SELECT source, target, level FROM x QUALIFY row_number() OVER (PARTITION BY source ORDER BY level, target) = 1""")
def graph_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    methods = M.table(spark, sf_dir, "part").select(k.alias("id"), k.alias("type"), F.get(F.split("p_name", " "), 1).alias("name"), F.when(k % 4 > 0, k % 4).alias("arity"))
    return V.overrides(methods, _closure(spark, sf_dir))


@query(f"""WITH {N}, c AS (SELECT o_orderkey AS route_id, p_name AS name, CASE o_orderkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN 'Brand#' || (1 + o_orderkey % 5) || (1 + o_custkey % 5) ELSE 'none' END AS wanted FROM orders JOIN part ON o_orderkey % 180 = p_partkey),
m AS (SELECT route_id, id, CASE WHEN lower(container) = lower(wanted) THEN 0 WHEN lower(string_split(file, '/')[-1]) = lower(wanted) THEN 1 ELSE 2 END AS preference FROM c JOIN n USING (name))
SELECT route_id, id, preference FROM m QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY preference, id) = 1""")
def graph_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey"), M.table(spark, sf_dir, "part")
    brand = F.concat(F.lit("Brand#"), (1 + k % 5).cast("string"), (1 + F.col("o_custkey") % 5).cast("string"))
    wanted = F.when(k % 3 == 0, F.upper("p_type")).when(k % 3 == 1, brand).otherwise("none")
    calls = M.table(spark, sf_dir, "orders").join(p, k % 180 == F.col("p_partkey")).select(k.alias("route_id"), F.col("p_name").alias("name"), wanted.alias("container"))
    return V.routes(calls, M.nodes(spark, sf_dir).select("id", "name", "container", "file"))


@query(f"""WITH {E}, w AS (SELECT unnest(['nation:3', 'nation:7', 'part:5', 'part:9']) AS id) SELECT DISTINCT source AS owner, target AS id, 'member' AS role FROM e WHERE label = 'contains' AND source IN (SELECT id FROM w)
UNION ALL SELECT DISTINCT target, source, 'implementer' FROM e WHERE label = 'supplies' AND target IN (SELECT id FROM w)""")
def graph_owner_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = spark.createDataFrame([(x,) for x in ("nation:3", "nation:7", "part:5", "part:9")], "id string")
    return V.owner_members(M.edges(spark, sf_dir), owners, ("contains",), ("supplies",))


@query(f"""WITH {E}, s AS (SELECT DISTINCT 'order:' || doc_id AS id FROM documents WHERE doc_id % 9 = 0 UNION SELECT DISTINCT 'part:' || (doc_id % 60) FROM documents WHERE doc_id % 11 = 0),
k AS (SELECT source, target, label FROM e WHERE label IN ('uses', 'creates', 'contains')),
b AS (SELECT target AS neighbor, label AS relation, source AS seed, 'outgoing' AS direction FROM k WHERE source IN (SELECT id FROM s) UNION ALL SELECT source, label, target, 'incoming' FROM k WHERE target IN (SELECT id FROM s) AND source NOT IN (SELECT id FROM s)),
p AS (SELECT *, CASE WHEN relation IN ('uses', 'creates') AND direction = 'incoming' THEN 3 WHEN relation IN ('uses', 'creates') THEN 2 ELSE 1 END AS priority FROM b),
u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY neighbor, relation, seed ORDER BY priority DESC, direction DESC) = 1)
SELECT neighbor, relation, seed, direction, CASE priority WHEN 3 THEN 'direct_consumer' WHEN 2 THEN 'direct_dependency' ELSE 'structural_neighbor' END AS reason FROM u ORDER BY priority DESC, neighbor, relation, seed LIMIT 120""")
def graph_memory_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that name orders and parts."""
    d = M.table(spark, sf_dir, "documents")
    seeds = d.where("doc_id % 9 = 0").select(M.key("order", "doc_id").alias("id")).unionByName(d.where("doc_id % 11 = 0").select(F.concat(F.lit("part:"), (F.col("doc_id") % 60).cast("string")).alias("id")))
    return V.memory_neighbors(seeds, M.edges(spark, sf_dir), 120)


@query(f"""WITH {N}, u AS (SELECT unnest(['src', 'src/part', 'src/customer/3', 'tests/customer']) AS folder) SELECT path, arg_max(folder, length(folder)) AS unit FROM (SELECT DISTINCT file AS path FROM n) JOIN u ON starts_with(path, folder || '/') GROUP BY 1""")
def src_nearest_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = spark.createDataFrame([(x, x) for x in ("src", "src/part", "src/customer/3", "tests/customer")], "folder string, unit string")
    return V.nearest_unit(M.nodes(spark, sf_dir).select(F.col("file").alias("path")).distinct(), units)


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, a AS (SELECT ancestor FROM k WHERE id = 121), m AS (SELECT doc_id AS id, CASE WHEN doc_id % 8 > 0 THEN doc_id % 130 END AS c, CASE doc_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' ELSE '' END AS branch, doc_id % 10 = 0 AS stale FROM documents),
x AS (SELECT id, CASE WHEN c IS NULL THEN 'unknown' WHEN c = 121 THEN 'current' WHEN c IN (SELECT ancestor FROM a) THEN 'ancestor' ELSE 'diverged' END AS relation, branch <> '' AND branch <> 'main' AS branch_mismatch, stale FROM m)
SELECT id, relation, branch_mismatch, stale OR relation = 'diverged' AS stale FROM x""")
def doc_revision_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits are the parts' keys, each with its third as parent; HEAD is 121."""
    k = F.col("doc_id")
    m = M.table(spark, sf_dir, "documents").select(k.alias("id"), F.when(k % 8 > 0, (k % 130).cast("string")).alias("commit"), F.when(k % 3 == 0, "main").when(k % 3 == 1, "dev").otherwise("").alias("branch"), (k % 10 == 0).alias("stale"))
    above = _closure(spark, sf_dir).where("id = 121").select(F.col("ancestor").cast("string").alias("commit"))
    return V.revision_status(m, above, "121", "main")


@query("""WITH c AS (SELECT o_orderkey AS call_id, o_orderkey % 400 AS name, 'Brand#' || (1 + o_orderkey % 5) || (1 + o_custkey % 5) AS module FROM orders), s AS (SELECT p_partkey % 70 AS name, p_brand AS module FROM part),
m AS (SELECT call_id, CASE WHEN c.module = s.module THEN 4 ELSE 0 END AS score FROM c JOIN s USING (name)), b AS (SELECT call_id, count(*) AS candidates, count(*) FILTER (score = top) AS best_ties FROM (SELECT *, max(score) OVER (PARTITION BY call_id) AS top FROM m) GROUP BY 1)
SELECT count(*) FILTER (best_ties = 1) AS bound, count(*) FILTER (best_ties BETWEEN 2 AND 4) AS ambiguous, count(*) FILTER (best_ties > 4) AS suppressed, count(*) FILTER (candidates IS NULL) AS unresolved FROM c LEFT JOIN b USING (call_id)""")
def graph_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    calls = M.table(spark, sf_dir, "orders").select(k.alias("call_id"), (k % 400).alias("name"), F.concat(F.lit("Brand#"), (1 + k % 5).cast("string"), (1 + F.col("o_custkey") % 5).cast("string")).alias("module"))
    symbols = M.table(spark, sf_dir, "part").select((F.col("p_partkey") % 70).alias("name"), F.col("p_brand").alias("module"))
    return V.suppression(calls.select("call_id").join(V.candidate_ties(calls, symbols), "call_id", "left"))


INCLUDES = ["src/part/Brand#1*", "tests", "src/order/F"]


@query(f"WITH {N} SELECT path, {' OR '.join(f'regexp_matches(path, {chr(39)}{V.include_pattern(r)}{chr(39)})' for r in INCLUDES)} AS included FROM (SELECT DISTINCT file AS path FROM n)")
def src_include_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nodes(spark, sf_dir).select(F.col("file").alias("path")).distinct().select("path", V.include_scope(F.col("path"), INCLUDES).alias("included"))


@query(f"""WITH {N}, {E}, u AS (SELECT n.file FROM e JOIN n ON n.id = e.source WHERE label = 'creates') SELECT CASE WHEN regexp_matches(file, '{paths.TEST_PATH}') THEN file ELSE 'production' END AS file, count(*) AS uses FROM u GROUP BY 1""")
def graph_tests_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = M.edges(spark, sf_dir).where("label = 'creates'").select(F.col("source").alias("id")).join(M.nodes(spark, sf_dir).select("id", "file"), "id")
    rest, tests = P.tests_apart(uses, F.col("file").rlike(paths.TEST_PATH))
    return tests.unionByName(rest.agg(F.lit("production").alias("file"), F.count("*").alias("uses")))


@query(f"""WITH {N}, {E}, {_rounds_sql(SPREAD_SQL, 2, CHANGED)}, {DEGREES}, h AS (SELECT id, hop FROM h1 UNION ALL SELECT id, hop FROM h2)
SELECT id, hop, name, degree, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 250 AS truncated FROM h LEFT JOIN n USING (id) LEFT JOIN d USING (id) ORDER BY hop, coalesce(degree, 0) DESC, coalesce(name, ''), id LIMIT 250""")
def graph_impact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = M.nodes(spark, sf_dir), M.edges(spark, sf_dir)
    found = P.spread(e, n.where(F.lower("name") == CHANGED).select("id"), 2, reasons=False)
    return P.capped(found, n.select("id", "name").join(G.degree(e), "id", "left")).select("id", "hop", "name", "degree", "total", "truncated")


@query(f"""WITH {N}, {E}, v AS (SELECT source AS "at", target AS "to" FROM e UNION ALL SELECT target, source FROM e), s AS (SELECT id FROM n WHERE contains(lower(name), 'red ring')),
h AS (SELECT id, min(hop) AS hop FROM (SELECT id, 0 AS hop FROM s UNION ALL SELECT "to", 1 FROM v JOIN s ON s.id = v."at") GROUP BY 1)
SELECT reason, count(*) AS nodes FROM (SELECT CASE WHEN contains(lower(name), 'red') OR contains(lower(name), 'ring') THEN 'shared terms' WHEN hop > 0 THEN 'relation' ELSE 'index' END AS reason FROM h JOIN n USING (id)) GROUP BY 1""")
def graph_selection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = M.nodes(spark, sf_dir)
    name = F.lower("name")
    near = T.hops(T.undirected(M.edges(spark, sf_dir)), n.where(name.contains("red ring")), 1).select("id", "hop").join(n.select("id", "name"), "id")
    matched = F.when(name.contains("red"), 1).otherwise(0) + F.when(name.contains("ring"), 1).otherwise(0)
    return near.select(B.selection_reason(F.col("hop"), matched).alias("reason")).groupBy("reason").agg(F.count("*").alias("nodes"))


@query(f"""WITH t AS (SELECT DISTINCT item_id AS doc, unnest({TOKEN_SQL.format('text')}) AS term FROM benchmark), s AS (SELECT term FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12), k AS (SELECT * FROM t WHERE term IN (SELECT term FROM s)),
p AS (SELECT x.doc AS a, y.doc AS b, count(*) AS shared FROM k x JOIN k y USING (term) WHERE x.doc < y.doc GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT a AS id, b AS other, shared FROM p UNION ALL SELECT b, a, shared FROM p), r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY shared DESC, other) <= 2)
SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, shared FROM r""")
def doc_semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity edges of a semantic graph over benchmark items: at most two a node."""
    posts = R.postings(M.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), "text"))
    p = R.related_pairs(posts.select("doc", "term").distinct(), 2, 12)
    both = p.select(F.col("a").alias("id"), F.col("b").alias("other"), "shared").unionByName(p.select(F.col("b").alias("id"), F.col("a").alias("other"), "shared"))
    top = R.best_per_group(both, ["id"], [F.desc("shared"), "other"], 2)
    return top.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "shared").distinct()
