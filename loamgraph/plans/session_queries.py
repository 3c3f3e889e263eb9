"""Queries of the session, routing, ranking and evidence operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as X
from loamgraph.operators import retrieval as R
from loamgraph.operators import session as O
from loamgraph.plans.graph_queries import E, N
from loamgraph.plans.source_queries import TOKEN_SQL
from loamgraph.plans.text_queries import FOLDED_SQL, MEM, MSG
from loamgraph.sources import model as M

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


@query(f"WITH {N}, {E}, b AS (SELECT id FROM n WHERE lower(name) IN ('red ring', 'asia', 'europe')) SELECT label, count(*) AS relations FROM e WHERE source NOT IN (SELECT id FROM b) AND target NOT IN (SELECT id FROM b) GROUP BY 1")
def graph_keyword_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kept = O.drop_keyword_noise(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), ["red ring", "asia", "europe"])
    return kept.groupBy("label").agg(F.count("*").alias("relations"))


@query(f"""WITH {MSG}, k AS ({M.MEMORIES_SQL}), a AS (SELECT session, count(*) AS messages, max(seq) AS last_seq FROM m GROUP BY 1), b AS (SELECT session, count(DISTINCT digest) AS memories FROM k GROUP BY 1)
SELECT session, messages, last_seq, coalesce(memories, 0) AS memories FROM a LEFT JOIN b USING (session)""")
def msg_session_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.session_catalog(M.messages(spark, sf_dir), M.memories(spark, sf_dir))


NAMES = ["the", "der", "une"]
ROUTED_SQL = f"""{MSG}, s AS (SELECT session, seq, CASE WHEN k = 1 THEN CASE WHEN a THEN 'the' WHEN b THEN 'der' ELSE 'une' END WHEN k > 1 THEN '-' END AS signal FROM (
  SELECT *, a::INT + b::INT + c::INT AS k FROM (SELECT session, seq, contains(lower(content), 'the') AS a, contains(lower(content), 'der') AS b, contains(lower(content), 'une') AS c FROM m))),
r AS (SELECT session, seq, nullif(last_value(signal IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING), '-') AS project FROM s)"""


@query(f"WITH {ROUTED_SQL} SELECT * FROM r")
def msg_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.route(M.messages(spark, sf_dir), NAMES)


@query(f"""WITH {ROUTED_SQL} SELECT status, count(*) AS sessions FROM (SELECT CASE WHEN count(project) = 0 THEN 'unassigned' WHEN count(DISTINCT project) > 1 THEN 'ambiguous' WHEN count(project) < count(*) THEN 'partial' ELSE 'routed' END AS status
  FROM r GROUP BY session) GROUP BY 1""")
def msg_route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.route_status(O.route(M.messages(spark, sf_dir), NAMES)).groupBy("status").agg(F.count("*").alias("sessions"))


@query(f"""WITH {MSG}, t AS (SELECT DISTINCT session, unnest({TOKEN_SQL.format('content')}) AS term FROM m) SELECT term, count(*) AS sessions FROM t GROUP BY 1 HAVING count(*) >= 10""")
def msg_term_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.messages(spark, sf_dir).select("session", F.explode(X.tokens(F.col("content"))).alias("term")).distinct()
    return t.groupBy("term").agg(F.count("*").alias("sessions")).where("sessions >= 10")


@query(f"WITH {MSG} SELECT session, count(*) FILTER (seq <= 2) AS processed, count(*) FILTER (seq > 2) AS pending FROM m GROUP BY 1")
def msg_topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.messages(spark, sf_dir).groupBy("session").agg(F.count_if(F.col("seq") <= 2).alias("processed"), F.count_if(F.col("seq") > 2).alias("pending"))


FACTS = {"greets": ["the", "and"], "lists": [r"\.$"], "numbers": ["[0-9]", "%"]}
FORBIDDEN = {"doubt": ["not", "of"], "digits": ["[0-9]{4}"]}


def _grade_sql() -> str:
    hits = lambda ps: " + ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '(?im){p}') THEN 1 ELSE 0 END" for p in ps)
    covered = " + ".join(f"CASE WHEN ({hits(ps)}) = {len(ps)} THEN 1 ELSE 0 END" for ps in FACTS.values())
    partial = " + ".join(f"CASE WHEN ({hits(ps)}) > 0 AND ({hits(ps)}) < {len(ps)} THEN 1 ELSE 0 END" for ps in FACTS.values())
    errors = " + ".join(f"CASE WHEN ({hits(ps)}) = {len(ps)} THEN 1 ELSE 0 END" for ps in FORBIDDEN.values())
    return f"""WITH g AS (SELECT conv_id * 1000 + turn AS answer_id, CAST({covered} AS BIGINT) AS covered, CAST({partial} AS BIGINT) AS partial, CAST({errors} AS BIGINT) AS factual_errors FROM conversations WHERE role = 'assistant')
SELECT *, round((covered + 0.5::DOUBLE * partial) / {len(FACTS)}, 4) AS score, round(greatest(0.0::DOUBLE, covered + 0.5::DOUBLE * partial - factual_errors) / {len(FACTS)}, 4) AS adjusted_score FROM g"""


@query(_grade_sql())
def eval_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text")
    return O.grade(a, FACTS, FORBIDDEN)


@query(f"""WITH {N}, d AS (SELECT file, unnest(list_distinct(string_split(file, '/')[:-2])) AS name FROM n) SELECT name, count(*) AS files FROM d GROUP BY 1 HAVING count(*) * 20 >= (SELECT count(*) FROM n)""")
def graph_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.segments(M.nodes(spark, sf_dir).select(F.col("file").alias("path")))


@query(f"WITH {N} SELECT t.term, count(*) AS names FROM n JOIN (SELECT unnest(['red', 'bolt', 'customer', 'order', 'zzz']) AS term) t ON contains(lower(n.name), t.term) GROUP BY 1")
def graph_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("name")
    hits = F.filter(F.array(*[F.when(name.contains(t), F.lit(t)) for t in ("red", "bolt", "customer", "order", "zzz")]), lambda x: x.isNotNull())
    return M.nodes(spark, sf_dir).select(F.explode(hits).alias("term")).groupBy("term").agg(F.count("*").alias("names"))


@query(f"WITH {N}, t AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS turn FROM n) SELECT * FROM t WHERE turn <= 15 ORDER BY turn, kind LIMIT 15")
def graph_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.round_robin(M.nodes(spark, sf_dir).select("kind", "id", "name"), "kind", ["name", "id"], 15).select("kind", "id", F.col("turn").cast("long").alias("turn"))


@query(f"WITH {N} SELECT name, container, kind, min(id) AS id, count(*) AS definitions FROM n GROUP BY 1, 2, 3")
def graph_role_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nodes(spark, sf_dir).groupBy("name", "container", "kind").agg(F.min("id").alias("id"), F.count("*").alias("definitions"))


@query(f"""WITH t AS (SELECT item_id, {TOKEN_SQL.format('text')} AS t FROM benchmark) SELECT item_id, array_to_string(CASE WHEN len(t) <= 24 THEN t
  ELSE list_concat(list_concat(t[1:8], list_transform(range(8), lambda i: t[CAST(9 + floor(i * (len(t) - 16) / 8) AS INT)])), t[-8:]) END, ' ') AS terms FROM t""")
def doc_spaced_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(O.spaced_terms(F.col("text")), " ").alias("terms"))


def _obligations_sql() -> str:
    cases = [f"CASE WHEN regexp_matches(asked, '{O.cue_pattern(cues)}') AND NOT regexp_matches(answer, '{shown}') THEN '{k}' END" for k, (cues, shown) in O.OBLIGATIONS.items()]
    return f"""WITH p AS (SELECT conv_id, turn, {FOLDED_SQL.format("text")} AS asked, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations
  UNION ALL SELECT -1, doc_id, {FOLDED_SQL.format("text")}, substr(text, 1, 200) FROM documents)
SELECT conv_id, turn, array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ',') AS missing FROM p WHERE answer IS NOT NULL"""


@query(_obligations_sql())
def msg_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and the answers after them; every document stands for a request that its own start answers."""
    c = M.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer"))
    d = M.table(spark, sf_dir, "documents").select(F.lit(-1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), "text", F.substring("text", 1, 200).alias("answer"))
    return c.unionByName(d).where("answer is not null").select("conv_id", "turn", F.array_join(O.obligations(F.col("text"), F.col("answer")), ",").alias("missing"))


@query("""WITH o AS (SELECT p_type || p_brand AS contract, 'part:' || p_partkey AS id FROM part), n AS (SELECT contract, count(*) AS n FROM o GROUP BY 1), c AS (SELECT o_orderkey AS call_id, p_type || p_brand AS contract FROM orders JOIN part ON o_orderkey % 500 = p_partkey)
SELECT call_id, id AS target, 'INFERRED' AS confidence FROM c JOIN o USING (contract) JOIN n USING (contract) WHERE n <= 8 UNION ALL SELECT call_id, n || ' overrides', 'AMBIGUOUS' FROM c JOIN n USING (contract) WHERE n > 8""")
def graph_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", "p_brand").alias("contract"))
    calls = M.table(spark, sf_dir, "orders").join(p, F.col("o_orderkey") % 500 == F.col("p_partkey")).select(F.col("o_orderkey").alias("call_id"), "contract")
    return O.dispatch(calls, p.select("contract", M.key("part", "p_partkey").alias("id")))


@query(f"""WITH {E}, b AS (SELECT source AS id, target AS other FROM e WHERE source <> target UNION SELECT target, source FROM e WHERE source <> target)
SELECT id, other, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other) AS place FROM b) WHERE place <= 6""")
def graph_first_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_neighbors(M.edges(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {N}, {E}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1 HAVING count(*) >= 20),
a AS (SELECT label, count(*) AS n FROM e WHERE confidence = 'AMBIGUOUS' GROUP BY 1), h AS (SELECT id, name, degree, row_number() OVER (PARTITION BY lower(name) ORDER BY degree DESC, id) AS k FROM n JOIN d USING (id) WHERE kind IN ('part', 'supplier', 'nation') AND length(name) >= 3),
f AS (SELECT * FROM h WHERE k = 1 ORDER BY degree DESC, id LIMIT 5)
SELECT 'ambiguous_relations' AS signal, 'medium' AS level, CAST(sum(n) AS BIGINT) AS n, array_to_string((list(label || '=' || n ORDER BY n DESC, label))[1:6], ',') AS names FROM a HAVING sum(n) > 0
UNION ALL SELECT 'unresolved_relations', 'medium', count(*), '' FROM e WHERE confidence = 'UNRESOLVED' HAVING count(*) > 0
UNION ALL SELECT 'high_connectivity_hotspots', 'review', count(*), string_agg(name, ',' ORDER BY degree DESC, id) FROM f HAVING count(*) > 0
UNION ALL SELECT 'no_indexed_tests', 'medium', 0, '' FROM n HAVING count(*) FILTER (contains(lower(file), 'test')) = 0
UNION ALL SELECT 'routes_without_resolved_controller', 'review', count(*), '' FROM n WHERE kind = 'customer' AND id NOT IN (SELECT source FROM e WHERE label = 'creates') HAVING count(*) > 0
UNION ALL SELECT 'missing_architecture_documentation', 'low', 0, ''""")
def graph_risk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.risk_signals(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), False, ("part", "supplier", "nation"), "customer", M.CREATES)
    return found.withColumn("names", F.array_join("names", ","))


TOOL_NAMES = ["Read", "Grep", "Write", "Bash", "Task", "LS"]
COMMANDS = ["cd x && rg 'a b' src", "make; cat a.txt | grep x", "git commit", "git  grep -n y", "ls -laR /", "echo cat", "  sed -n 1,5p f", "catalog"]


def _tool_sql() -> str:
    tools = " ".join(f"WHEN name = '{k}' THEN '{v}'" for k, v in O.TOOLS.items())
    names = ", ".join(f"'{n}'" for n in TOOL_NAMES)
    commands = ", ".join("'" + c.replace("'", "''") + "'" for c in COMMANDS)
    return rf"""WITH c AS (SELECT [{names}][event_id % {len(TOOL_NAMES)} + 1] AS name, [{commands}][event_id % {len(COMMANDS)} + 1] AS command FROM events),
s AS (SELECT *, list_filter(list_transform(string_split_regex(command, '{O.SEGMENTS}'), lambda p: CASE WHEN regexp_matches(trim(p), '{O.SEARCH_COMMAND}') THEN 'search' WHEN regexp_matches(trim(p), '{O.READ_COMMAND}') THEN 'read' END), lambda k: k IS NOT NULL) AS ks FROM c)
SELECT name, command, coalesce(CASE WHEN name = 'Bash' THEN ks[1] {tools} END, 'none') AS kind, count(*) AS calls FROM s GROUP BY ALL"""


@query(_tool_sql())
def hist_tool_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: every tool with every command."""
    pick = lambda of: F.get(F.array(*[F.lit(x) for x in of]), (F.col("event_id") % len(of)).cast("int"))
    c = M.table(spark, sf_dir, "events").select(pick(TOOL_NAMES).alias("name"), pick(COMMANDS).alias("command"))
    return c.withColumn("kind", F.coalesce(O.classify_tool(F.col("name"), F.col("command")), F.lit("none"))).groupBy("name", "command", "kind").agg(F.count("*").alias("calls"))


@query(f"""WITH {MSG}, u AS (SELECT * FROM m WHERE role IN ('assistant', 'tool') AND regexp_matches(content, '{O.DECISIVE}') AND NOT regexp_matches(content, '{O.CASUAL}')),
l AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS back FROM u) SELECT session, string_agg(role || ': ' || substr(content, 1, 1200), chr(10) ORDER BY seq) AS content, count(*) AS messages FROM l WHERE back <= 6 GROUP BY 1""")
def msg_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.proposals(M.messages(spark, sf_dir))


@query("""WITH l AS (SELECT user_id AS key, ts, event_id AS version, CASE WHEN event_type = 'error' THEN 'deleted' ELSE event_type END AS status FROM events)
SELECT key, version, status FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, version DESC) = 1 AND status <> 'deleted'""")
def hist_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("version"), F.when(F.col("event_type") == "error", "deleted").otherwise(F.col("event_type")).alias("status"))
    return O.current_version(e, "key", "ts").select("key", "version", "status")


@query(f"""WITH {MSG}, a AS (SELECT DISTINCT 'session:' || session AS source, agent AS target, 'participated' AS label FROM m UNION ALL SELECT 'session:' || session, 'message:' || (session * 1000 + seq), 'produced' FROM m
  UNION ALL SELECT DISTINCT agent, 'memory:' || digest, 'created' FROM ({M.MEMORIES_SQL}) k) SELECT label, count(*) AS relations, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM a GROUP BY 1""")
def graph_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = M.messages(spark, sf_dir), M.memories(spark, sf_dir)
    s = M.key("session", "session")
    e = m.select(s.alias("source"), F.col("agent").alias("target"), F.lit("participated").alias("label")).distinct()
    e = e.unionByName(m.select(s.alias("source"), F.concat(F.lit("message:"), (F.col("session") * 1000 + F.col("seq")).cast("string")).alias("target"), F.lit("produced").alias("label")))
    e = e.unionByName(k.select(F.col("agent").alias("source"), F.concat(F.lit("memory:"), "digest").alias("target"), F.lit("created").alias("label")).distinct())
    return e.groupBy("label").agg(F.count("*").alias("relations"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


@query(f"""WITH {MEM} SELECT kind, status, count(*) AS memories, count(DISTINCT digest) AS texts, CAST(sum(greatest(1, strlen(content) // 4)) AS BIGINT) AS tokens FROM m GROUP BY ALL""")
def doc_memory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.memories(spark, sf_dir)
    return m.groupBy("kind", "status").agg(F.count("*").alias("memories"), F.count_distinct("digest").alias("texts"), F.sum(X.token_estimate(F.col("content"))).alias("tokens"))


@query(f"""WITH q AS (SELECT DISTINCT unnest({TOKEN_SQL.format("text")}) AS term FROM benchmark), t AS (SELECT session, seq, role, list_distinct({TOKEN_SQL.format("content")}) AS ts FROM ({M.MESSAGES_SQL}) m),
s AS (SELECT session, seq, len(list_intersect(ts, (SELECT list(term) FROM q))) AS overlap, role FROM t), r AS (SELECT session, seq, overlap * 12 + CASE WHEN role = 'assistant' THEN 30 ELSE 0 END AS score FROM s WHERE overlap > 0)
SELECT session, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, seq) AS k FROM r) WHERE k <= 2 ORDER BY score DESC, session, seq LIMIT 30""")
def msg_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = M.table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    m = M.messages(spark, sf_dir)
    hits = m.select("session", "seq", "role", F.explode(F.array_distinct(X.tokens(F.col("content")))).alias("term")).join(q, "term").groupBy("session", "seq", "role").agg(F.count("*").alias("overlap"))
    scored = hits.select("session", "seq", (F.col("overlap") * 12 + F.when(F.col("role") == "assistant", 30).otherwise(0)).alias("score"))
    return R.best_per_group(scored, ["session"], [F.desc("score"), "seq"], 2).drop("place").orderBy(F.desc("score"), "session", "seq").limit(30)


@query()
def eval_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamgraph.operators.memory import paired

    return O.bootstrap(paired(M.table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "1-URGENT", "5-LOW"), "delta")
