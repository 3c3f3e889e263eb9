"""Queries of the source, intent, risk and streaming operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import text as X
from loamgraph.functions.lineage import scratch, shared_dir
from loamgraph.operators import graph as G
from loamgraph.operators import impact as P
from loamgraph.operators import retrieval as R
from loamgraph.operators import source as S
from loamgraph.operators import traverse as T
from loamgraph.plans import intent as I
from loamgraph.plans.graph_queries import BOTH_SQL, CHANGED, E, N, _rounds_sql
from loamgraph.sources import model as M
from loamgraph.streaming import tail, topics

QUERIES: dict = {}
SQL: dict[str, str] = {}
RULES = ["tests/", "*Brand#1*", "!src/part/Brand#13", "src/order/P"]


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ignored_sql() -> str:
    out = "false"
    for rule in RULES:
        pattern, negated = S.rule_pattern(rule)
        out = f"CASE WHEN regexp_matches(path, '{pattern}') THEN {str(not negated).lower()} ELSE {out} END"
    return out


@query(f"WITH {N} SELECT path, {_ignored_sql()} AS ignored FROM (SELECT DISTINCT file AS path FROM n)")
def src_ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ignored(M.nodes(spark, sf_dir).select(F.col("file").alias("path")).distinct(), RULES)


@query("""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
r AS (SELECT doc, i, length(line) + 1 AS n, sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY i) AS t FROM l)
SELECT doc, CAST(floor((t - 1) / 1800) AS BIGINT) AS chunk, min(i) + 1 AS first_line, max(i) + 1 AS last_line, CAST(sum(n) AS BIGINT) AS chars FROM r GROUP BY ALL""")
def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return S.sections(d).select("doc", "chunk", F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), F.col("chars").cast("long").alias("chars"))


@query("""SELECT doc_id, kind, count(*) AS found FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(the|and|der|que|les) [a-z]+', 1)) AS kind FROM documents) GROUP BY ALL""")
def doc_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(the|and|der|que|les) [a-z]+"), 1)).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("found"))


@query(r"""SELECT doc_id, least(50, len(list_distinct(list_filter(regexp_extract_all(text, '([A-Za-z0-9_./-]+\.(?:py|js|ts|md|sql|java|go|rs|html|json))', 1), lambda p: NOT starts_with(p, '/') AND NOT contains(p, '..'))))) AS mentions FROM documents""")
def doc_file_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.table(spark, sf_dir, "documents").select("doc_id", F.size(X.file_mentions(F.col("text"))).cast("long").alias("mentions"))


@query("""WITH w AS (SELECT DISTINCT item_id, lower(x) AS term FROM (SELECT item_id, unnest(string_split_regex(text, '[^A-Za-z]+')) AS x FROM benchmark) WHERE length(x) >= 4),
u AS (SELECT term, min(item_id) AS item_id FROM w GROUP BY 1 HAVING count(*) = 1),
t AS (SELECT DISTINCT doc_id, lower(x) AS term FROM (SELECT doc_id, unnest(string_split_regex(text, '[^A-Za-z]+')) AS x FROM documents) WHERE length(x) >= 4)
SELECT doc_id AS source, item_id AS target, count(*) AS mentions FROM t JOIN u USING (term) GROUP BY ALL""")
def doc_symbol_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def words(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.split("text", "[^A-Za-z]+")).alias("x")).where(F.length("x") >= 4).select(key, F.lower("x").alias("term")).distinct()

    names = words(M.table(spark, sf_dir, "benchmark"), "item_id").groupBy("term").agg(F.min("item_id").alias("target"), F.count("*").alias("n")).where("n = 1")
    met = words(M.table(spark, sf_dir, "documents"), "doc_id").join(names, "term")
    return met.groupBy(F.col("doc_id").alias("source"), "target").agg(F.count("*").alias("mentions"))


@query()
def doc_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.table(spark, sf_dir, "documents")
    return d.select("doc_id", S.feature_vector(X.tokens(F.col("text"))).alias("vector"))


def _cues_sql(column: str) -> str:
    score = {k: " + ".join(f"CASE WHEN contains(lower({column}), '{c}') THEN {w} ELSE 0 END" for c, w in cues.items()) for k, cues in I.CUES.items()}
    top = f"greatest({', '.join(score.values())})"
    return "CASE " + " ".join(f"WHEN ({s}) = {top} AND {top} > 0 THEN '{k}'" for k, s in score.items()) + " ELSE 'overview' END"


@query(f"SELECT intent, count(*) AS messages FROM (SELECT {_cues_sql('text')} AS intent FROM conversations) GROUP BY 1")
def msg_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.table(spark, sf_dir, "conversations").select(I.classify_intent(F.col("text")).alias("intent")).groupBy("intent").agg(F.count("*").alias("messages"))


def _concept_sql(query: str, limit: int) -> str:
    terms = I.concept_terms(query)
    matched = " + ".join(f"CASE WHEN contains(t, '{x}') THEN 1 ELSE 0 END" for x in terms)
    listed = ", ".join(f"'{x}'" for x in terms)
    return f"""x AS (SELECT *, lower(name) || ' ' || lower(coalesce(container, '')) AS t FROM n), g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1),
y AS (SELECT *, {matched} AS k, contains(t, '{query}') AS w FROM x), z AS (SELECT id, name, CASE WHEN w THEN 100 ELSE 0 END + 10 * k + CASE WHEN lower(name) IN ({listed}) THEN 30 ELSE 0 END + least(10, coalesce(degree, 0)) AS score
  FROM y LEFT JOIN g USING (id) WHERE w OR k > 0), found AS (SELECT * FROM z ORDER BY score DESC, name, id LIMIT {limit})"""


@query(f"WITH {N}, {E}, {_concept_sql('red ring', 12)} SELECT * FROM found")
def graph_concept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.concept_search(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), "red ring")


@query(f"""WITH {N}, {E}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1),
t AS (SELECT id, kind, degree, row_number() OVER (PARTITION BY kind ORDER BY degree DESC, id) AS turn FROM n JOIN d USING (id)) SELECT * FROM t WHERE turn <= 12 ORDER BY turn, kind LIMIT 12""")
def graph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overview(M.nodes(spark, sf_dir), M.edges(spark, sf_dir)).select("id", "kind", "degree", F.col("turn").cast("long").alias("turn"))


@query(f"""WITH {N}, {E}, {_concept_sql('red ring', 5)}, v AS ({BOTH_SQL}),
h AS (SELECT id, min(hop) AS hop FROM (SELECT id, 0 AS hop FROM found UNION ALL SELECT "to", 1 FROM v JOIN found ON found.id = v."at") GROUP BY 1),
c AS (SELECT id, name, hop, greatest(1, strlen('{{"id":"' || id || '","name":"' || name || '","file":"' || file || '"}}') // 4) + 1 AS cost, row_number() OVER (PARTITION BY name ORDER BY hop, id) AS place FROM h JOIN n USING (id)),
s AS (SELECT *, sum(cost) OVER w AS spent, row_number() OVER w AS k FROM c WHERE place <= 2 WINDOW w AS (ORDER BY hop, id ROWS UNBOUNDED PRECEDING))
SELECT id, name, hop, cost, 'N' || k AS alias FROM s WHERE spent <= 400 OR k = 1""")
def graph_evidence_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.evidence_package(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), "red ring")


#: How a change spreads: to consumers, into what is contained, both ways along other relations.
SPREAD_SQL = """SELECT target AS "at", source AS "to", label, confidence FROM e WHERE label <> 'contains' UNION ALL SELECT source, target, label, confidence FROM e WHERE label NOT IN ('uses', 'creates')"""


@query(f"""WITH {N}, {E}, {_rounds_sql(SPREAD_SQL, 3, CHANGED)}, s AS (SELECT file, line % 7 = 0 AS signature FROM n WHERE lower(name) = '{CHANGED}'),
h AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 WHERE (SELECT bool_or(signature) FROM s)),
c AS (SELECT (SELECT count(DISTINCT file) FROM s) AS code_files, 0 AS doc_files, (SELECT count(*) FILTER (signature) FROM s) AS signature_changes, count(*) FILTER (hop = 1 AND label <> 'contains') AS direct,
  count(*) FILTER (label = 'contains') AS containment, count(*) FILTER (hop > 1 AND label <> 'contains') AS transitive FROM h), r AS (SELECT *, CAST(least(100, 5 * code_files + 12 * signature_changes + 3 * direct + transitive + least(5, containment // 8)) AS BIGINT) AS score FROM c)
SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM r""")
def graph_impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk of a change to all definitions of a name; every seventh line's signature counts as changed."""
    n = M.nodes(spark, sf_dir)
    symbols = n.where(F.lower("name") == CHANGED).select("id", "file", (F.col("line") % 7 == 0).alias("signature"))
    depth = P.depth(symbols)
    return I.risk_score(symbols.select(F.col("file").alias("path")).distinct(), symbols, P.spread(M.edges(spark, sf_dir), symbols, depth))


DIFF_SQL = """SELECT p_size AS diff, p_partkey * 10 + k AS no, CASE k WHEN 1 THEN '+++ b/src/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.json' ELSE '.png' END
  WHEN 2 THEN '@@ -1,2 +' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ',' || (p_partkey % 3) END || ' @@' WHEN 3 THEN CASE WHEN p_partkey % 3 = 0 THEN '+def part(x):' ELSE '+x = 1' END ELSE '-old line' END AS line
  FROM part, (SELECT unnest([1, 2, 3, 4]) AS k)"""


@query(f"""WITH l AS ({DIFF_SQL}), f AS (SELECT *, last_value(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END IGNORE NULLS) OVER (PARTITION BY diff ORDER BY no ROWS UNBOUNDED PRECEDING) AS file FROM l),
g AS (SELECT diff, file, string_agg(substr(line, 2), chr(10) ORDER BY no) FILTER (regexp_matches(line, '^[+-]') AND NOT regexp_matches(line, '^([+][+][+]|---)')) AS changed,
  max(TRY_CAST(regexp_extract(line, '^@@.*?[+]([0-9]+)', 1) AS BIGINT)) FILTER (starts_with(line, '@@')) AS lo, max(TRY_CAST(coalesce(nullif(regexp_extract(line, '^@@.*?[+][0-9]+,([0-9]+)', 1), ''), '1') AS BIGINT)) FILTER (starts_with(line, '@@')) AS n FROM f GROUP BY 1, 2),
t AS (SELECT *, list_filter([CASE WHEN ends_with(file, '.png') THEN 'asset' END, CASE WHEN ends_with(file, '.json') THEN 'configuration' END, CASE WHEN ends_with(file, '.md') THEN 'documentation' END,
  CASE WHEN contains(changed, 'def part(') THEN 'signature' END], lambda x: x IS NOT NULL) AS ts FROM g)
SELECT diff, file, CASE WHEN n = 0 THEN '' ELSE lo || '-' || (lo + n - 1) END AS ranges, CASE WHEN len(ts) = 0 THEN 'logic' ELSE array_to_string(ts, ',') END AS types FROM t""")
def graph_diff_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs made of the parts of each size: a file a part, with one hunk."""
    key, k = F.col("p_partkey"), F.col("k")
    suffix = F.when(key % 4 == 0, ".py").when(key % 4 == 1, ".md").when(key % 4 == 2, ".json").otherwise(".png")
    hunk = F.concat(F.lit("@@ -1,2 +"), key.cast("string"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(","), (key % 3).cast("string"))), F.lit(" @@"))
    line = F.when(k == 1, F.concat(F.lit("+++ b/src/"), key.cast("string"), suffix)).when(k == 2, hunk).when(k == 3, F.when(key % 3 == 0, "+def part(x):").otherwise("+x = 1")).otherwise("-old line")
    lines = M.table(spark, sf_dir, "part").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(F.col("p_size").alias("diff"), (key * 10 + k).alias("no"), line.alias("line"))
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat(r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string"))), ",")
    return P.diff_files(lines).select("diff", "file", ranges.alias("ranges"), F.array_join("types", ",").alias("types"))


@query(f"WITH {N}, {E} SELECT count(*) AS edges, count(*) FILTER (source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)) AS dangling, count(*) FILTER (file IS NULL OR line IS NULL) AS unlocated, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous FROM e")
def graph_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.validate_package(M.nodes(spark, sf_dir), M.edges(spark, sf_dir))


TOKEN_SQL = f"regexp_extract_all(lower(regexp_replace({{}}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '{X.WORD}')"


@query(f"""WITH k AS (SELECT DISTINCT unnest({TOKEN_SQL.format('text')}) AS term FROM benchmark),
c AS (SELECT conv_id * 1000 + turn AS answer_id, unnest(range(len(s))) AS claim, unnest(s) AS sentence FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[.!?]\\s+'), lambda x: length(x) > 0) AS s FROM conversations WHERE role = 'assistant')),
w AS (SELECT answer_id, claim, list_distinct(list_filter({TOKEN_SQL.format('sentence')}, lambda t: length(t) >= 5)) AS ts FROM c),
p AS (SELECT answer_id, claim, len(ts) AS terms, len(list_filter(ts, lambda t: t IN (SELECT term FROM k))) AS supported FROM w)
SELECT verdict, count(*) AS claims FROM (SELECT CASE WHEN terms = 0 THEN 'abstained' WHEN supported = terms THEN 'supported' WHEN supported >= 0.5 * terms THEN 'partially_supported' WHEN supported > 0 THEN 'ambiguous' ELSE 'unsupported' END AS verdict FROM p) GROUP BY 1""".replace("len(list_filter(ts, lambda t: t IN (SELECT term FROM k)))", "len(list_intersect(ts, (SELECT list(term) FROM k)))"))
def msg_claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text")
    known = M.table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("term"))
    return I.validate_claims(c, known).groupBy("verdict").agg(F.count("*").alias("claims"))


@query("""WITH p AS (SELECT DISTINCT label AS branch, vec_id % 97 AS file FROM embeddings) SELECT x.branch AS a, y.branch AS b, count(*) AS shared FROM p x JOIN p y ON x.file = y.file AND x.branch < y.branch GROUP BY ALL""")
def graph_branch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.table(spark, sf_dir, "embeddings").select(F.col("label").alias("branch"), (F.col("vec_id") % 97).alias("file")).distinct()
    met = p.select("file", F.col("branch").alias("a")).join(p.select("file", F.col("branch").alias("b")), "file").where("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"))


@query(f"""WITH {N}, {E}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e WHERE label <> 'contains' UNION ALL SELECT target FROM e WHERE label <> 'contains') GROUP BY 1),
t AS (SELECT id FROM n JOIN d USING (id) ORDER BY degree DESC, id LIMIT 300) SELECT DISTINCT source, target, label FROM e WHERE label <> 'contains' AND source IN (SELECT id FROM t) AND target IN (SELECT id FROM t) AND source <> target""")
def graph_export_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = M.nodes(spark, sf_dir), M.edges(spark, sf_dir).where("label <> 'contains'")
    top = n.select("id").join(G.degree(e), "id").orderBy(F.desc("degree"), "id").limit(300)
    return G.induced(top, e).where("source <> target").select("source", "target", "label").distinct()


@query("""WITH s AS (SELECT user_id, event_type, date_trunc('day', ts) AS day FROM events) SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM s GROUP BY ALL""")
def stream_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream, all files at once, in tumbling windows of a day, through a sink and back."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = tail.action_counts(tail.stream_table(spark, sf_dir, "events"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    return done.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "events")


@query("""WITH l AS (SELECT DISTINCT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 'n' || turn END AS id FROM conversations WHERE conv_id % 7 <> 0)
SELECT role, count(*) AS messages, count(id) AS with_id FROM l GROUP BY 1""")
def stream_tail_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON lines, taken in twice from a growing folder, with repeats, broken and blank lines; each message once."""
    base = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"
    c = M.table(spark, sf_dir, "conversations").where("conv_id % 7 <> 0")
    fields = F.struct(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), "role", F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("n"), F.col("turn").cast("string"))).alias("id"))
    lines = c.select(F.to_json(fields).alias("value"))
    broken = spark.createDataFrame([("{\"session\": \"1\"}",), ("not json",), (" ",)], "value string")
    lines.where("hash(value) % 2 = 0").unionByName(broken).write.mode("append").text(f"{base}/in")
    tail.tail_json_lines(spark, f"{base}/in", f"{base}/table", f"{base}/state")
    lines.write.mode("append").text(f"{base}/in")
    tail.tail_json_lines(spark, f"{base}/in", f"{base}/table", f"{base}/state")
    return spark.read.parquet(f"{base}/table").groupBy("role").agg(F.count("*").alias("messages"), F.count("id").alias("with_id"))


@query(f"""WITH m AS (SELECT session, seq, greatest(1, strlen(content) // 4) AS cost FROM ({M.MESSAGES_SQL})) SELECT session, max(seq) AS last_seq, count(*) AS messages FROM m GROUP BY 1""")
def stream_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compaction cursor of every session after all messages came as a stream."""
    base = f"{shared_dir(spark)}/cursor-{uuid.uuid4().hex}"
    M.messages(spark, sf_dir).select("session", "seq", "content").write.parquet(f"{base}/in")
    rows = spark.readStream.schema("session long, seq long, content string").parquet(f"{base}/in")
    cursors = tail.stream_cursor(rows)
    cursors.writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{base}/out").groupBy("session").agg(F.max_by(F.struct("last_seq", "messages"), "batch").alias("c"))
    return last.select("session", "c.last_seq", "c.messages")


@query()
def msg_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of all messages, taken in as a stream that is restarted once; a message's first word stands for the function that it is about."""
    base = scratch(spark, "topics")
    m = M.messages(spark, sf_dir).select(F.col("agent").alias("owner"), "session", "seq", F.col("seq").alias("at"), "role", F.concat(F.lit("function "), F.coalesce("content", F.lit(""))).alias("content"))
    schema = "owner string, session long, seq long, at long, role string, content string"
    for part in ("seq < 2", "seq >= 2"):
        m.where(part).write.mode("append").parquet(f"{base}/in")
        topics.run_topics(spark, f"{base}/in", schema, f"{base}/out", f"{base}/state")
    done = spark.read.parquet(f"{base}/out")
    return done.groupBy("session").agg(F.count_distinct("topic").alias("topics"), F.count_if(F.col("action") == "continued").alias("continued"), F.count("*").alias("messages"))


@query("""WITH m AS (SELECT p_partkey AS id, lower(p_name) AS text FROM part), q AS (SELECT 'red' AS t UNION ALL SELECT 'bolt') SELECT id, count(*) AS hits FROM m JOIN q ON contains(text, t) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""")
def graph_heap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("p_name")
    hits = F.when(text.contains("red"), 1).otherwise(0) + F.when(text.contains("bolt"), 1).otherwise(0)
    return M.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hits.cast("long").alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "id").limit(25)


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id, turn, n FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, turn) <= 2 AND (SELECT count(*) FROM r) > 0""")
def msg_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return R.best_per_group(c, ["conv_id"], [F.desc("n"), "turn"], 2).drop("place")
