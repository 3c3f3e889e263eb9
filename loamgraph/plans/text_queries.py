"""Queries over events, conversations, documents, pages and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import text as X
from loamgraph.functions.lineage import scratch
from loamgraph.operators import memory as Y
from loamgraph.operators import retrieval as R
from loamgraph.sources import model as M
from loamgraph.streaming import tail

QUERIES: dict = {}
SQL: dict[str, str] = {}
MSG, MEM, OBS = f"m AS ({M.MESSAGES_SQL})", f"m AS ({M.MEMORIES_SQL})", f"o AS ({M.OBSERVATIONS_SQL})"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- events ------------------------------------------------------------------------------------------------


@query(f"WITH {OBS} SELECT id, session, ts, action FROM o ORDER BY ts DESC, id DESC LIMIT 50")
def hist_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.observations(spark, sf_dir).select("id", "session", "ts", "action").orderBy(F.desc("ts"), F.desc("id")).limit(50)


@query(f"WITH {OBS} SELECT id, session, action FROM o WHERE (contains(lower(details), '\"k\": 7') OR contains(lower(action), 'sign')) AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def hist_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = M.observations(spark, sf_dir)
    return o.where((F.lower("details").contains('"k": 7') | F.lower("action").contains("sign")) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))).select("id", "session", "action")


@query(f"""WITH {OBS} SELECT session, count(*) AS queries, count(*) FILTER (action = 'purchase') AS sufficient, count(*) FILTER (action = 'error') AS undelivered, round(sum(value), 2) AS total FROM o GROUP BY 1""")
def hist_usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.observations(spark, sf_dir).groupBy("session").agg(F.count("*").alias("queries"), F.count_if(F.col("action") == "purchase").alias("sufficient"), F.count_if(F.col("action") == "error").alias("undelivered"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {OBS} SELECT CAST(json_extract(details, '$.k') AS BIGINT) AS k, count(*) AS uses FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def hist_top_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("details", "$.k").cast("long")
    return M.observations(spark, sf_dir).groupBy(k.alias("k")).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "k").limit(5)


@query(f"""WITH {OBS} SELECT action, count(*) AS events, round(sum(value), 2) AS total, round(avg(value), 4) AS mean FROM (SELECT * FROM o ORDER BY ts DESC, id DESC LIMIT 500) GROUP BY 1""")
def hist_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = M.observations(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).limit(500)
    return newest.groupBy("action").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"))


AS_OF = "2024-02-01"


@query(f"""WITH {OBS} SELECT action, kept, count(*) AS events FROM (SELECT action, action = 'purchase' OR ts >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY AS kept FROM o) GROUP BY ALL""")
def hist_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return Y.retained(M.observations(spark, sf_dir), as_of, 20, F.col("action") == "purchase").groupBy("action", "kept").agg(F.count("*").alias("events"))


@query(f"""WITH {OBS}, s AS (SELECT session AS node, CASE action WHEN 'purchase' THEN 1.0 WHEN 'click' THEN -0.75 ELSE -1.0 END::DECIMAL(3,2) AS value, ts, value < 20 AS stale FROM o WHERE action IN ('purchase', 'click', 'error')),
t AS (SELECT node, round(sum(value * round(pow(0.5::DOUBLE, greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0::DOUBLE) / 30.0::DOUBLE), 4)::DECIMAL(5,4)), 4)::DOUBLE AS score,
  count(*) AS signals, count(*) FILTER (stale) AS stale_signals FROM s GROUP BY 1)
SELECT *, CASE WHEN score >= 0.5 THEN 'preferred' WHEN score <= -0.5 THEN 'contested' ELSE 'tentative' END AS label FROM t""")
def hist_learning_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = M.observations(spark, sf_dir).where("action in ('purchase', 'click', 'error')")
    outcome = F.when(F.col("action") == "purchase", "useful").when(F.col("action") == "click", "dead_end").otherwise("corrected")
    return Y.learning_overlay(o.select(F.col("session").alias("node"), outcome.alias("outcome"), "ts", (F.col("value") < 20).alias("stale")), F.lit(AS_OF).cast("timestamp_ntz"))


@query(f"""WITH {OBS}, l AS (SELECT *, last_value(CASE WHEN action = 'signup' THEN id END IGNORE NULLS) OVER w AS pid, last_value(CASE WHEN action = 'signup' THEN ts END IGNORE NULLS) OVER w AS pts FROM o
  WINDOW w AS (PARTITION BY session ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) SELECT pid AS package_id, id AS read_id FROM l WHERE action = 'view' AND pid IS NOT NULL AND ts <= pts + INTERVAL 6 HOUR""")
def hist_after_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.after_package(M.observations(spark, sf_dir), F.col("action") == "signup", F.col("action") == "view", "6 hours")


MANIFEST_SQL = "SELECT 'u' || user_id AS path, md5(string_agg(event_type, ',' ORDER BY event_id)) AS digest FROM events WHERE ts {} TIMESTAMP '2024-01-15' GROUP BY 1"


@query(f"""WITH a AS ({MANIFEST_SQL.format('<')}), b AS ({MANIFEST_SQL.format('>=')}) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM a FULL JOIN b USING (path) WHERE a.digest IS DISTINCT FROM b.digest""")
def hist_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = M.table(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp_ntz")

    def manifest(df: DataFrame) -> DataFrame:
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ",")
        return df.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path")).agg(F.md5(listed).alias("digest"))

    return Y.manifest_diff(manifest(e.where(F.col("ts") < at)), manifest(e.where(F.col("ts") >= at)))


# --- conversations -----------------------------------------------------------------------------------------


@query(f"WITH {MSG} SELECT session, seq, agent, role, content FROM m QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) = 1")
def msg_latest_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.latest_per_session(M.messages(spark, sf_dir))


@query(f"""WITH {MSG}, l AS (SELECT session, seq, role, last_value(CASE WHEN role = 'user' THEN seq END IGNORE NULLS) OVER w AS prompt_seq, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER w AS prompt FROM m
  WINDOW w AS (PARTITION BY session, agent ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT session, seq, prompt_seq, prompt FROM l WHERE role = 'assistant'""")
def msg_prior_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.prior_prompt(M.messages(spark, sf_dir)).select("session", "seq", "prompt_seq", "prompt")


@query(f"""WITH {MSG} SELECT session, seq, length(content) AS score FROM m QUALIFY row_number() OVER (PARTITION BY session ORDER BY length(content) DESC, seq) <= 2""")
def msg_best_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.messages(spark, sf_dir).withColumn("score", F.length("content").cast("long"))
    return R.best_per_group(m, ["session"], [F.desc("score"), "seq"], 2).select("session", "seq", "score")


@query(f"""WITH {MSG}, p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS place FROM m), a AS (SELECT session, place AS anchor FROM p WHERE seq = 3)
SELECT session, seq, place - anchor AS distance FROM p JOIN a USING (session) WHERE place - anchor BETWEEN -2 AND 2""")
def msg_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.messages(spark, sf_dir)
    return Y.window_around(m, m.where("seq = 3")).select("session", "seq", F.col("distance").cast("long").alias("distance"))


@query(f"""WITH {MSG}, r AS (SELECT session, seq, greatest(1, strlen(content) // 4) AS cost, sum(greatest(1, strlen(content) // 4)) OVER w AS spent, count(*) OVER w AS position FROM m WINDOW w AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT session, seq, cost, CAST(spent AS BIGINT) AS spent FROM r WHERE spent <= 600 OR position = 1""")
def msg_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.budget_prefix(M.messages(spark, sf_dir), "session", ["seq"], X.token_estimate(F.col("content")), 600).select("session", "seq", "cost", "spent")


@query(f"""WITH {MSG} SELECT session, count(*) AS messages, max(seq) AS last_seq FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 10""")
def msg_sessions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.messages(spark, sf_dir).groupBy("session").agg(F.count("*").alias("messages"), F.max("seq").alias("last_seq"))
    return Y.page(s, [F.desc("messages"), "session"], 10, 20)


def _cues_sql(cues: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(t, '{c}')" for c in cues)


FOLDED_SQL = f"translate(lower(coalesce({{}}, '')), '{X.ACCENTS[0]}', '{X.ACCENTS[1]}')"


@query(f"""WITH {MSG}, c AS (SELECT session, seq, {FOLDED_SQL.format('content')} AS t FROM m UNION ALL SELECT doc_id, -1, {FOLDED_SQL.format('text')} FROM documents)
SELECT session, seq, CASE WHEN {_cues_sql(X.PROPOSED)} THEN 'proposed' WHEN {_cues_sql(X.OBSERVED)} THEN 'observed' ELSE 'historical' END AS state FROM c""")
def msg_evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session"), F.lit(-1).cast("long").alias("seq"), F.col("text").alias("content"))
    return M.messages(spark, sf_dir).select("session", "seq", "content").unionByName(d).select("session", "seq", X.evidence_state(F.col("content")).alias("state"))


@query(f"""WITH {MSG}, t AS (SELECT session, seq, regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g') AS t FROM m WHERE role = 'assistant'),
r AS (SELECT session, seq, list_filter([CASE WHEN length(t) < 40 THEN 'too_short' END, CASE WHEN t <> '' AND contains(',:;-(', right(t, 1)) THEN 'trailing_fragment' END,
  CASE WHEN ((length(t) - length(replace(t, '```', ''))) // 3) % 2 = 1 THEN 'unclosed_code_fence' END,
  CASE WHEN length(t) - length(replace(t, '(', '')) > length(t) - length(replace(t, ')', '')) THEN 'unclosed_parenthesis' END], lambda x: x IS NOT NULL) AS r FROM t)
SELECT session, seq, len(r) > 0 AS incomplete, array_to_string(r, ',') AS reasons FROM r""")
def msg_incomplete_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return M.messages(spark, sf_dir).where("role = 'assistant'").select("session", "seq", X.incomplete(c).alias("incomplete"), F.array_join(X.incomplete_reasons(c), ",").alias("reasons"))


@query(f"WITH {MSG} SELECT agent, role, count(*) AS messages, CAST(sum(greatest(1, strlen(content) // 4)) AS BIGINT) AS tokens FROM m GROUP BY ALL")
def msg_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.messages(spark, sf_dir).groupBy("agent", "role").agg(F.count("*").alias("messages"), F.sum(X.token_estimate(F.col("content"))).alias("tokens"))


@query(f"""WITH {MSG} SELECT session, role, sha256(content) AS digest, 1::BIGINT AS copies, CAST(min(CASE WHEN seq <= 2 THEN 1 ELSE 2 END) AS INTEGER) AS run FROM m GROUP BY 1, 2, 3""")
def msg_idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First the early messages, then twice all of them, appended to one table: each (session, role, digest) once, by the run that brought it."""
    m = M.messages(spark, sf_dir).select("session", "role", "seq", F.sha2(F.encode("content", "UTF-8"), 256).alias("digest"))
    path = scratch(spark, "append")
    for run, rows in enumerate((m.where("seq <= 2"), m, m), 1):
        tail.append_new(rows.select("session", "role", "digest", F.lit(run).alias("run")), path, ["session", "role", "digest"])
    return spark.read.parquet(path).groupBy("session", "role", "digest").agg(F.count("*").alias("copies"), F.min("run").alias("run"))


#: The first line of a handoff. Fixed value.
HANDOFF = "Handoff determinista de la sesión:"


@query(f"""WITH {MSG}, r AS (SELECT session, seq, role, content, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS k FROM m)
SELECT session, '{HANDOFF}' || chr(10) || string_agg(role || ': ' || substr(content, 1, 600), chr(10) ORDER BY seq) AS handoff FROM r WHERE k <= 12 GROUP BY 1""")
def msg_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = R.best_per_group(M.messages(spark, sf_dir), ["session"], [F.desc("seq")], 12)
    parts = F.array_sort(F.collect_list(F.struct("seq", F.concat("role", F.lit(": "), F.substring("content", 1, 600)).alias("c"))))
    return last.groupBy("session").agg(F.concat(F.lit(HANDOFF + "\n"), F.array_join(F.transform(parts, lambda p: p["c"]), "\n")).alias("handoff"))


# --- documents and memories --------------------------------------------------------------------------------

TOKENS_SQL = f"regexp_extract_all(lower(regexp_replace({{}}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '{X.WORD}')"


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents), p AS (SELECT doc_id, term FROM t GROUP BY ALL) SELECT term, count(*) AS df FROM p GROUP BY 1 HAVING count(*) >= 20")
def doc_postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return R.document_frequency(R.postings(d)).where("df >= 20")


@query(f"SELECT doc_id, len({TOKENS_SQL.format('text')}) AS tokens, len(list_distinct({TOKENS_SQL.format('text')})) AS terms FROM documents")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tokens(F.col("text"))
    return M.table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("terms"))


BM25_SQL = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark),
l AS (SELECT doc_id AS doc, {TOKENS_SQL.format('text')} AS ts FROM documents), n AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM l),
f AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ts) AS term FROM l) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT query_id, f.doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / a))), 6) AS score
  FROM q JOIN f USING (term) JOIN df USING (term) JOIN l ON l.doc = f.doc, n GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return R.bm25(docs, M.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(f"WITH {BM25_SQL} SELECT query_id, doc, round(score, 4) AS score FROM b WHERE rank <= 3")
def doc_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).where("rank <= 3").select("query_id", "doc", F.round("score", 4).alias("score"))


TRUTH_SQL = "t AS (SELECT item_id AS query_id, doc_id AS doc FROM benchmark JOIN documents d ON contains(d.text, benchmark.text))"


@query(f"""WITH {BM25_SQL}, {TRUTH_SQL}, h AS (SELECT t.query_id, count(*) AS relevant, count(rank) AS found, min(rank) AS first, sum(1.0 / log2(rank + 1)) AS dcg FROM t LEFT JOIN b ON t.query_id = b.query_id AND t.doc = b.doc GROUP BY 1)
SELECT count(*) AS queries, round(avg(found / relevant), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6)::DOUBLE AS mrr,
  round(avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1.0 / log2(i + 1)))), 6) AS ndcg FROM h""")
def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = M.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    truth = R.containing(M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), items)
    return R.evaluate(_bm25(spark, sf_dir).select("query_id", "doc", "rank"), truth)


@query(f"WITH {MEM} SELECT digest, kind, min(id) AS id, count(*) AS copies, count(DISTINCT session) AS sessions, min_by(agent, id) AS agent FROM m GROUP BY 1, 2")
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.merge_exact(M.memories(spark, sf_dir))


@query(f"WITH {MEM} SELECT id, agent, status FROM m WHERE (scope <> 'private' OR agent = 'src3') AND status NOT IN ('quarantined', 'superseded', 'deleted') AND agent IN ('src1', 'src2', 'src3')")
def doc_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.visible(M.memories(spark, sf_dir), "src3", ["src1", "src2", "src3"], restricted=True).select("id", "agent", "status")


@query(f"""WITH {MEM}, x AS (SELECT *, id % 11 = 0 AS stale, id % 13 = 0 AS missing, CASE id % 17 WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'timeout' ELSE 'ok' END AS outcome, id % 5 <> 0 AS observed,
  CASE WHEN id % 7 = 0 THEN 'integrity_verified' END AS level, id % 3 <> 0 AS metrics, id % 4 <> 0 AS evidence, CASE WHEN id % 2 = 0 THEN 'benchmark' END AS evidence_type FROM m)
SELECT policy, count(*) AS memories FROM (SELECT CASE WHEN stale THEN 'stale' WHEN missing THEN 'evidence_missing' WHEN status = 'contested' THEN 'contested' WHEN status = 'proposed' THEN 'proposed_only'
  WHEN outcome = 'failed' THEN 'execution_failed' WHEN outcome = 'cancelled' THEN 'execution_cancelled' WHEN outcome = 'timeout' THEN 'execution_timeout'
  WHEN NOT observed OR coalesce(level, CASE WHEN status = 'verified' THEN 'verified' ELSE 'imported_report' END) IN ('imported_report', 'integrity_verified', 'execution_declared') THEN 'imported_only'
  WHEN status <> 'verified' OR NOT metrics THEN 'historical_only' WHEN NOT evidence THEN 'unsupported' WHEN evidence_type = 'benchmark' THEN 'verified_measured' ELSE 'verified_fact' END AS policy FROM x) GROUP BY 1""")
def doc_claim_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    facts = {
        "stale": i % 11 == 0, "missing_dependencies": i % 13 == 0, "execution_outcome": F.when(i % 17 == 1, "failed").when(i % 17 == 2, "cancelled").when(i % 17 == 3, "timeout").otherwise("ok"),
        "execution_observed": i % 5 != 0, "verification_level": F.when(i % 7 == 0, "integrity_verified"), "verified_metrics": i % 3 != 0, "evidence": i % 4 != 0, "evidence_type": F.when(i % 2 == 0, "benchmark"),
    }
    return M.memories(spark, sf_dir).select(Y.claim_policy(F.col("status"), **facts).alias("policy")).groupBy("policy").agg(F.count("*").alias("memories"))


def _redactions_sql(column: str) -> str:
    """text.redactions() in SQL."""
    counts = [f"len(regexp_extract_all({_redacted_sql(column, k)}, '{p.replace(chr(39), chr(39) * 2)}'))" for k, (p, _) in enumerate(X.SECRETS)]
    return " + ".join(counts)


def _redacted_sql(column: str, steps: int = len(X.SECRETS)) -> str:
    out = column
    for p, to in X.SECRETS[:steps]:
        quoted = p.replace("'", "''")
        to = to.replace("$1", r"\1")
        out = f"regexp_replace({out}, '{quoted}', '{to}', 'g')"
    return out


@query(f"SELECT doc_id, CAST({_redactions_sql('text')} AS BIGINT) AS redactions, sha256({_redacted_sql('text')}) AS redacted_sha256 FROM documents")
def doc_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.redactions(F.col("text")).alias("redactions"), F.sha2(F.encode(X.redact(F.col("text")), "UTF-8"), 256).alias("redacted_sha256"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents),
r AS (SELECT *, sum(greatest(1, strlen(line) // 4) + 1) OVER (PARTITION BY doc_id ORDER BY no) AS t FROM l) SELECT doc_id, CAST(floor((t - 1) / 128) AS BIGINT) AS chunk, min(no) AS first_line, max(no) AS last_line FROM r GROUP BY ALL""")
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = M.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    t = F.sum(X.token_estimate(F.col("line")) + 1).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.withColumn("chunk", F.floor((t - 1) / 128)).groupBy("doc_id", "chunk").agg((F.min("i") + 1).cast("long").alias("first_line"), (F.max("i") + 1).cast("long").alias("last_line"))


@query(f"""WITH p AS (SELECT DISTINCT doc_id AS doc, unnest({TOKENS_SQL.format('text')}) AS term FROM documents), s AS (SELECT term FROM p GROUP BY 1 HAVING count(*) BETWEEN 2 AND (SELECT greatest(4, CAST(floor(count(*) * 0.015::DOUBLE) AS BIGINT)) FROM documents)),
k AS (SELECT * FROM p WHERE term IN (SELECT term FROM s)) SELECT x.doc AS a, y.doc AS b, count(*) AS shared FROM k x JOIN k y USING (term) WHERE x.doc < y.doc GROUP BY ALL HAVING count(*) >= 2""")
def doc_related_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share two specific terms or more; a term is specific in up to 1.5 % of the documents (four at least)."""
    d = M.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return R.related_lists(R.term_lists(d), 2, max(4, int(d.count() * 0.015)))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets, count(*) FILTER (starts_with(href, '/')) AS relative FROM l GROUP BY 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = M.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"), F.count_if(F.col("href").startswith("/")).alias("relative"))


@query("""WITH s AS (SELECT doc_id, position(lang IN text) AS start, position(lang IN text) + 30 AS "end" FROM documents WHERE contains(text, lang) UNION ALL SELECT doc_id, 1, 50 FROM documents),
m AS (SELECT *, CASE WHEN max("end") OVER w IS NULL OR start > max("end") OVER w + 40 THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, "end") AS island FROM m) SELECT doc_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY doc_id, island""")
def doc_snippet_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.table(spark, sf_dir, "documents")
    at = F.locate("x", "text")
    at = F.expr("locate(lang, text)").cast("long")
    spans = d.where(at > 0).select("doc_id", at.alias("start"), (at + 30).alias("end")).unionByName(d.select("doc_id", F.lit(1).cast("long").alias("start"), F.lit(50).cast("long").alias("end")))
    return R.merge_spans(spans, "doc_id")


# --- embeddings and evaluation -----------------------------------------------------------------------------

DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
TOPK_SQL = f"""SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id,
  round({DOT.format('v.embedding', 'q.embedding')} / (sqrt({DOT.format('v.embedding', 'v.embedding')}) * sqrt({DOT.format('q.embedding', 'q.embedding')})), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 10"""


def _vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = M.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.vector_topk(v, v.where("id % 50 = 0").withColumnRenamed("id", "query_id"))


@query(f"SELECT query_id, id, score FROM ({TOPK_SQL})")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_topk(spark, sf_dir).select("query_id", "id", "score")


@query(f"""WITH x AS ({TOPK_SQL}), y AS (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.label = q.label AND q.vec_id <> v.vec_id QUALIFY rank <= 10),
u AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS a, 0.0::DOUBLE AS b FROM x UNION ALL SELECT query_id, id, 0.0, 1.0::DOUBLE / (60 + rank) FROM y),
s AS (SELECT query_id, id, round(sum(a), 6) AS rrf_vector, round(sum(b), 6) AS rrf_lexical, round(sum(a + b), 6) AS score FROM u GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vec_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = M.table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    lexical = R.first_alike(v.select(F.col("vec_id").alias("id"), "label"), q, "label", 10)
    return R.rrf({"vector": _vector_topk(spark, sf_dir).select("query_id", "id", "rank"), "lexical": lexical}).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag <> 'A'), e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linestatus = 'O'),
c AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM f JOIN e USING (o, p)) AS "right")
SELECT *, round("right" / found, 6) AS "precision", round("right" / expected, 6) AS recall, round(2 * ("right" / found) * ("right" / expected) / ("right" / found + "right" / expected), 6) AS f1 FROM c""")
def eval_truth_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = M.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), "l_returnflag", "l_linestatus")
    return R.truth_f1(li.where("l_returnflag <> 'A'"), li.where("l_linestatus = 'O'"), ["o", "p"])


@query("""WITH g AS (SELECT o_custkey AS task, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS a, avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS b FROM orders GROUP BY 1)
SELECT task, round(a, 4) AS a_mean, round(b, 4) AS b_mean, round(b - a, 4) AS delta FROM g WHERE a IS NOT NULL AND b IS NOT NULL""")
def eval_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Y.paired(M.table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "1-URGENT", "5-LOW")
    return p.select(F.col("o_custkey").alias("task"), *[F.round(c, 4).alias(c) for c in ("a_mean", "b_mean", "delta")])


@query("SELECT o_orderpriority, count(*) AS runs, round(avg(o_totalprice), 4) AS mean, round(1.96::DOUBLE * coalesce(stddev_samp(o_totalprice), 0) / sqrt(count(*)), 4) AS half_width FROM orders GROUP BY 1")
def eval_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.run_summary(M.table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
