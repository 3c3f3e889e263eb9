"""Graph queries over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import paths
from loamgraph.functions.lineage import written
from loamgraph.operators import graph as G
from loamgraph.operators import traverse as T
from loamgraph.sources import model as M

SYMBOL = "order 7"
CHANGED = "red widget"
N, E, U = (f"{name} AS ({sql})" for name, sql in (("n", M.NODES_SQL), ("e", M.EDGES_SQL), ("u", M.USES_SQL)))
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


@query(f"WITH {N} SELECT kind, scope, production, count(*) AS nodes FROM (SELECT kind, {paths.SCOPE_SQL.format('file')} AS scope, {paths.PRODUCTION_SQL.format('file')} AS production FROM n) GROUP BY ALL")
def graph_nodes_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = M.nodes(spark, sf_dir)
    return n.select("kind", paths.scope(F.col("file")).alias("scope"), paths.production(F.col("file")).alias("production")).groupBy("kind", "scope", "production").agg(F.count("*").alias("nodes"))


@query(f"""WITH {N}, {E}, k AS (SELECT id FROM n WHERE {paths.SCOPE_SQL.format('file')} = 'production')
SELECT label, count(*) AS relations FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) GROUP BY 1""")
def graph_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = M.nodes(spark, sf_dir).where(paths.scope(F.col("file")) == "production")
    return G.induced(kept, M.edges(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("relations"))


SCORE_SQL = """round(greatest(0.05::DOUBLE, least(0.99::DOUBLE, CASE confidence WHEN 'AMBIGUOUS' THEN 0.35::DOUBLE WHEN 'INFERRED' THEN 0.58::DOUBLE WHEN 'EXTRACTED' THEN 0.82::DOUBLE ELSE 0.5::DOUBLE END
  - least(0.3::DOUBLE, (greatest(candidates, 1) - 1) * 0.06::DOUBLE) + least(0.12::DOUBLE, resolution_score * 0.01::DOUBLE)
  + CASE WHEN coalesce(file, '') <> '' AND coalesce(line, 0) <> 0 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END)), 3)"""
RANK_SQL = "CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 WHEN 'EXTRACTED' THEN 2 WHEN 'REVIEWED' THEN 3 WHEN 'TYPED' THEN 4 ELSE -1 END"


@query(f"""WITH {U}, s AS (SELECT *, {SCORE_SQL} AS confidence_score FROM u)
SELECT source, target, label, confidence, confidence_score, file, line, occurrences FROM (
  SELECT *, count(*) OVER (PARTITION BY source, target, label) AS occurrences,
    row_number() OVER (PARTITION BY source, target, label ORDER BY {RANK_SQL} DESC, confidence_score DESC, coalesce(file, ''), coalesce(line, 0)) AS r FROM s) WHERE r = 1""")
def graph_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = G.dedup_edges(M.uses(spark, sf_dir), ("source", "target", "label"))
    return best.select("source", "target", "label", "confidence", "confidence_score", "file", "line", "occurrences")


@query(f"WITH {E} SELECT label, confidence, candidates, {SCORE_SQL} AS confidence_score, count(*) AS relations FROM e GROUP BY ALL")
def graph_confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.scored(M.edges(spark, sf_dir)).groupBy("label", "confidence", "candidates", "confidence_score").agg(F.count("*").alias("relations"))


@query(f"WITH {E} SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT source AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY 1")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree(M.edges(spark, sf_dir))


@query(f"""WITH {N}, {E}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e WHERE label <> 'contains' UNION ALL SELECT target FROM e WHERE label <> 'contains') GROUP BY 1)
SELECT n.id, n.name, n.file, n.line, d.degree FROM n JOIN d USING (id) WHERE kind NOT IN ('region', 'nation') AND {paths.PRODUCTION_SQL.format('file')}
  AND coalesce(line, 0) <> 0 AND NOT regexp_matches(name, '{G.TEST_NAME}') AND name IN (SELECT name FROM n WHERE kind NOT IN ('region', 'nation') AND coalesce(file, '') <> '' GROUP BY 1 HAVING count(*) <= 2) ORDER BY degree DESC, file, line, id LIMIT 10""")
def graph_god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.god_nodes(M.nodes(spark, sf_dir), M.edges(spark, sf_dir))


@query(f"""WITH {N}, {E}, m AS (SELECT source AS id FROM e UNION SELECT target FROM e), c AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM m)) AS isolated,
  (SELECT count(*) FROM n WHERE kind IN ('part', 'order', 'region')) AS structural, (SELECT count(*) FROM n WHERE kind IN ('part', 'order', 'region') AND file <> '' AND line <> 0) AS located, count(*) AS edges,
  count(*) FILTER (confidence = 'EXTRACTED') AS extracted, count(*) FILTER (confidence = 'INFERRED') AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (confidence = 'UNRESOLVED') AS unresolved FROM e)
SELECT *, round(located / structural, 4) AS location_coverage, round(ambiguous / edges, 4) AS ambiguous_rate, round(inferred / edges, 4) AS inferred_rate, round((1 - (ambiguous + unresolved) / edges) * 100, 2) AS health FROM c""")
def graph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quality(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), ("part", "order", "region"))


@query(f"WITH {E} SELECT label, confidence, count(*) AS relations FROM e GROUP BY ALL")
def graph_relation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_confidence(M.edges(spark, sf_dir))


PAIRS_SQL = f"""SELECT least(a.file, b.file) AS a, greatest(a.file, b.file) AS b, count(*) AS weight FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target
  WHERE label <> 'contains' AND a.file <> b.file AND {paths.PRODUCTION_SQL.format('a.file')} AND {paths.PRODUCTION_SQL.format('b.file')} GROUP BY 1, 2"""


@query(f"WITH {N}, {E} {PAIRS_SQL}")
def graph_file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.file_pairs(M.nodes(spark, sf_dir), M.edges(spark, sf_dir))


@query(f"""WITH {N}, {E} SELECT a.container AS source_part, b.container AS target_part, count(*) AS relations FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target
WHERE confidence = 'EXTRACTED' AND label <> 'contains' AND a.container <> b.container GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 8""")
def graph_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.crossings(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), F.col("container"))


def _rounds_sql(view: str, depth: int, symbol: str) -> str:
    """CTEs h0..h<depth> of T.hops() over view v(at, to, label, confidence) from seeds h0(id)."""
    out = [f"v AS ({view})", f"h0 AS (SELECT id, 0 AS hop, NULL AS via, NULL AS label, NULL AS confidence FROM n WHERE lower(name) = '{symbol}')"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM h{j}" for j in range(k))
        out.append(f"""h{k} AS (SELECT "to" AS id, {k} AS hop, "at" AS via, label, confidence FROM (
  SELECT v.*, row_number() OVER (PARTITION BY "to" ORDER BY v."at", v.label, v.confidence) AS r FROM v JOIN h{k - 1} ON h{k - 1}.id = v."at" WHERE "to" NOT IN ({seen})) WHERE r = 1)""")
    return ", ".join(out)


VIEW_SQL = """SELECT target AS "at", source AS "to", label, confidence FROM e UNION ALL SELECT source, target, label, confidence FROM e WHERE label NOT IN ('uses', 'creates')"""
BOTH_SQL = """SELECT source AS "at", target AS "to", label, confidence FROM e UNION ALL SELECT target, source, label, confidence FROM e"""


@query(f"""WITH {N}, {E}, {_rounds_sql(BOTH_SQL, 2, SYMBOL)} SELECT id, hop FROM h0 UNION ALL SELECT id, hop FROM h1 UNION ALL SELECT id, hop FROM h2""")
def graph_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.neighborhood(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), SYMBOL, 2)


@query(f"""WITH {N}, {E}, {_rounds_sql(VIEW_SQL, 2, CHANGED)} SELECT h.id, n.name, hop, via, label, confidence FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) h LEFT JOIN n ON n.id = h.id""")
def graph_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.blast_radius(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), CHANGED, 2)


def _path_sql(start: str, goal: str, most: int) -> str:
    """T.shortest_path() by unrolled rounds: the least path to each new id, until one level has the goal."""
    out = [f"v AS (SELECT DISTINCT \"at\", \"to\" FROM ({BOTH_SQL}))", f"f0 AS (SELECT '{start}' AS id, ['{start}'] AS path)"]
    for k in range(1, most + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM f{j}" for j in range(k))
        out.append(f"f{k} AS (SELECT \"to\" AS id, min(list_append(path, \"to\")) AS path FROM f{k - 1} JOIN v ON v.\"at\" = f{k - 1}.id WHERE \"to\" NOT IN ({seen}) GROUP BY 1)")
    hits = " UNION ALL ".join(f"SELECT {k} AS hops, path FROM f{k} WHERE id = '{goal}'" for k in range(most + 1))
    return f"""WITH {E}, {', '.join(out)}, h AS ({hits}), b AS (SELECT path FROM h ORDER BY hops LIMIT 1) SELECT unnest(range(len(path))) AS step, unnest(path) AS id FROM b"""


@query(_path_sql("customer:3", "supplier:5", 4))
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shortest_path(M.edges(spark, sf_dir), "customer:3", "supplier:5", 4)


ANCHORS = ["part:1", "part:2", "part:3"]
ANCHOR_SQL = "a AS (SELECT unnest(['part:1', 'part:2', 'part:3']) AS id)"
DIRECT_SQL = "SELECT DISTINCT source AS id FROM e WHERE label IN ('uses', 'creates') AND target IN (SELECT id FROM a)"


def _anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in ANCHORS], "id string")


@query(f"WITH {E}, {ANCHOR_SQL} {DIRECT_SQL}")
def graph_direct_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.direct_consumers(M.edges(spark, sf_dir), _anchors(spark))


@query(f"""WITH {E}, {ANCHOR_SQL}, d AS ({DIRECT_SQL}) SELECT DISTINCT source AS id FROM e WHERE label IN ('uses', 'creates') AND target IN (SELECT id FROM d)
AND source NOT IN (SELECT id FROM d) AND source NOT IN (SELECT id FROM a)""")
def graph_indirect_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.indirect_consumers(M.edges(spark, sf_dir), _anchors(spark))


@query(f"""WITH {N}, {E}, {ANCHOR_SQL}, d AS ({DIRECT_SQL}), r AS (SELECT d.id, file, row_number() OVER (PARTITION BY file ORDER BY d.id) AS k FROM d JOIN n ON n.id = d.id)
SELECT file, count(*) AS consumers, string_agg(id, ',' ORDER BY id) FILTER (k <= 5) AS first_ids, greatest(0, count(*) - 5) AS remaining FROM r GROUP BY 1""")
def graph_consumer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.consumer_summary(M.nodes(spark, sf_dir), M.edges(spark, sf_dir), _anchors(spark))


@query("""WITH h AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS item FROM lineitem), q AS (SELECT DISTINCT l_orderkey AS "group", l_partkey AS item FROM lineitem),
s AS (SELECT "group", count(*) AS needed FROM q GROUP BY 1)
SELECT owner, "group" FROM (SELECT owner, "group", count(*) AS got FROM q JOIN h USING (item) GROUP BY ALL) JOIN s USING ("group") WHERE got = needed""")
def graph_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = M.table(spark, sf_dir, "lineitem")
    have = li.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("item")).distinct()
    return G.covers(have, li.select(F.col("l_orderkey").alias("group"), F.col("l_partkey").alias("item")).distinct())


@query("""WITH p AS (SELECT 'part:' || p_partkey AS id, lower(p_name || ' ' || p_size || ' ' || p_type) AS folded, p_brand AS project FROM part),
k AS (SELECT folded FROM p GROUP BY 1 HAVING count(*) <= 12 AND count(DISTINCT project) >= 2),
l AS (SELECT *, lead(id) OVER w AS target, lead(project) OVER w AS np FROM p WHERE folded IN (SELECT folded FROM k) WINDOW w AS (PARTITION BY folded ORDER BY id))
SELECT id AS source, target, folded FROM l WHERE target IS NOT NULL AND project <> np""")
def graph_cross_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.table(spark, sf_dir, "part").select(M.key("part", "p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), "p_type").alias("name"), "p_brand")
    return G.same_name_across(p, F.col("p_brand"))


def _communities_sql(rounds: int) -> str:
    out = ["b AS (SELECT a AS id, b AS other, weight FROM w UNION ALL SELECT b, a, weight FROM w)", "o AS (SELECT id, max(weight) AS weight FROM b GROUP BY 1)", "l0 AS (SELECT id, id AS community FROM o)"]
    for k in range(1, rounds + 1):
        out.append(f"""l{k} AS (SELECT id, community FROM (SELECT id, community, row_number() OVER (PARTITION BY id ORDER BY sum(weight) DESC, community) AS r FROM (
  SELECT b.id, l.community, weight FROM b JOIN l{k - 1} l ON l.id = b.other UNION ALL SELECT o.id, l.community, weight FROM o JOIN l{k - 1} l ON l.id = o.id) GROUP BY id, community) WHERE r = 1)""")
    return ", ".join(out)


def _heavy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and supplier-file pairs that meet more often than half the mean above it."""
    pairs = written(G.file_pairs(M.nodes(spark, sf_dir), M.edges(spark, sf_dir).where("label = 'supplies'")), "pairs")  # read several times
    mean = pairs.agg(F.avg("weight")).first()[0] or 0.0
    return pairs.where(F.col("weight") > 1.2 * mean)


HEAVY_SQL = f"""{N}, {E}, p AS ({PAIRS_SQL.replace("label <> 'contains'", "label = 'supplies'")}), w AS (SELECT * FROM p WHERE weight > 1.2::DOUBLE * (SELECT avg(weight) FROM p))"""


@query(f"WITH {HEAVY_SQL}, {_communities_sql(3)} SELECT id, community FROM l3")
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.propagate_labels(_heavy_pairs(spark, sf_dir), 3)


@query(f"""WITH {HEAVY_SQL}, {_communities_sql(3)} SELECT w.a, w.b, weight, x.community AS a_community, y.community AS b_community FROM w JOIN l3 x ON x.id = w.a JOIN l3 y ON y.id = w.b
WHERE x.community <> y.community ORDER BY weight DESC, w.a, w.b LIMIT 20""")
def graph_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _heavy_pairs(spark, sf_dir)
    return T.bridges(pairs, T.propagate_labels(pairs, 3))


@query(f"""WITH {HEAVY_SQL}, {_communities_sql(3)}, i AS (SELECT x.community, sum(weight) AS w FROM w JOIN l3 x ON x.id = w.a JOIN l3 y ON y.id = w.b WHERE x.community = y.community GROUP BY 1),
t AS (SELECT community, string_split(id, '/')[2] AS part, count(*) AS n FROM l3 GROUP BY 1, 2)
SELECT t.community, CAST(sum(n) AS BIGINT) AS members, CAST(coalesce(any_value(i.w), 0) AS BIGINT) AS inner_weight, arg_max(part, (n, -unicode(part))) AS label FROM t LEFT JOIN i ON i.community = t.community GROUP BY 1""")
def graph_community_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _heavy_pairs(spark, sf_dir)
    return T.community_stats(pairs, T.propagate_labels(pairs, 3), F.split("id", "/")[1])


@query("""WITH f AS (SELECT p_partkey AS fn, p_type || ' ' || p_size || ' ' || p_brand AS field FROM part), d AS (SELECT field FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6)
SELECT x.fn AS stage, y.fn AS other, x.field FROM f x JOIN f y USING (field) WHERE x.fn <> y.fn AND x.field IN (SELECT field FROM d)""")
def graph_state_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = M.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fn"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string"), "p_brand").alias("field"))
    rare = uses.groupBy("field").agg(F.count("*").alias("users")).where("users between 2 and 6").select("field")
    kept = uses.join(rare, "field", "left_semi")
    return kept.select("field", F.col("fn").alias("stage")).join(kept.select("field", F.col("fn").alias("other")), "field").where("stage <> other").select("stage", "other", "field")


@query(f"""WITH {N}, s AS (SELECT *, CASE WHEN kind = 'part' THEN CAST(line % 3 AS VARCHAR) ELSE CAST(line AS VARCHAR) END AS suffix, row_number() OVER (PARTITION BY file, name ORDER BY line, id) AS place FROM n),
t AS (SELECT *, row_number() OVER (PARTITION BY file, name, suffix, place = 1 ORDER BY line, id) AS nth FROM s)
SELECT id, CASE WHEN place = 1 THEN 'symbol:' || file || ':' || name WHEN kind IN ('part', 'order') THEN 'symbol:' || file || ':' || name || '/' || suffix || CASE WHEN nth = 1 THEN '' ELSE '@' || line END END AS qualified FROM t""")
def graph_overload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    arity = F.when(F.col("kind") == "part", F.col("line") % 3)
    return G.number_overloads(M.nodes(spark, sf_dir).withColumn("arity", arity), ("part", "order"))


@query(f"""WITH {U}, d AS (SELECT 'order:' || o_orderkey AS source, CASE WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'accepted' END AS decision FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT confidence, count(*) AS relations FROM (SELECT CASE WHEN confidence = 'AMBIGUOUS' AND decision = 'accepted' THEN 'REVIEWED' ELSE confidence END AS confidence
  FROM u LEFT JOIN d USING (source) WHERE NOT (confidence = 'AMBIGUOUS' AND coalesce(decision, '') = 'rejected')) GROUP BY 1""")
def graph_review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = M.uses(spark, sf_dir)
    o = M.table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    d = o.select(M.key("order", "o_orderkey").alias("source"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("accepted").alias("decision"))
    decisions = edges.select("source", "target", "label").distinct().join(d, "source")
    return G.apply_reviews(edges, decisions).groupBy("confidence").agg(F.count("*").alias("relations"))


@query(f"""WITH {U}, q AS (SELECT DISTINCT substr(sha256(source || chr(0) || target || chr(0) || label || chr(0) || coalesce(file, '') || chr(0) || CASE WHEN coalesce(line, 0) = 0 THEN '' ELSE CAST(line AS VARCHAR) END), 1, 20) AS review_key, source, target, label
  FROM u WHERE confidence IN ('AMBIGUOUS', 'REVIEWED')) SELECT *, CASE WHEN starts_with(review_key, '0') THEN 'accepted' WHEN starts_with(review_key, '1') THEN 'rejected' END AS decision FROM q""")
def graph_ambiguity_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions are given for the keys that start with 0 and 1."""
    edges = M.uses(spark, sf_dir)
    keys = edges.select(G.relation_key(*[F.col(c) for c in ("source", "target", "label", "file", "line")]).alias("review_key")).distinct()
    made = keys.where("review_key < '2'").withColumn("decision", F.when(F.col("review_key").startswith("0"), "accepted").otherwise("rejected"))
    return G.ambiguity_queue(edges, made).select("review_key", "source", "target", "label", "decision").distinct()


@query(f"""WITH {U}, s AS (SELECT 'order:' || (event_id * 3) AS source, 'part:' || user_id AS target FROM events)
SELECT count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM (SELECT DISTINCT source, target, source IN (SELECT 'order:' || o_orderkey FROM orders) AND target IN (SELECT 'part:' || p_partkey FROM part) AS ok FROM s)""")
def graph_type_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = M.table(spark, sf_dir, "events")
    side = ev.select(F.concat(F.lit("order:"), (F.col("event_id") * 3).cast("string")).alias("source"), M.key("part", "user_id").alias("target"), F.lit("uses").alias("label")).distinct()
    merged, bad = G.merge_typed(M.uses(spark, sf_dir), side, M.nodes(spark, sf_dir))
    return merged.where("confidence = 'TYPED'").agg(F.count("*").alias("accepted")).join(F.broadcast(bad.agg(F.count("*").alias("rejected"))))


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0),
r AS (SELECT child AS id, parent AS ancestor, 1 AS level FROM l UNION ALL SELECT r.id, l.parent, r.level + 1 FROM r JOIN l ON l.child = r.ancestor WHERE r.level < 8)
SELECT id, ancestor, min(level) AS level FROM r WHERE id <> ancestor GROUP BY 1, 2""")
def graph_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.table(spark, sf_dir, "part").where("p_partkey > 0")
    return T.ancestry(p.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent")))


@query(f"""WITH {E}, c AS (SELECT DISTINCT source AS caller, target AS callee FROM e WHERE confidence <> 'AMBIGUOUS' AND label IN ('uses', 'creates')),
k AS (SELECT * FROM c WHERE callee IN (SELECT callee FROM c GROUP BY 1 HAVING count(*) <= 20)),
s1 AS (SELECT caller, callee, 1 AS hop FROM k WHERE caller = 'customer:3'), s2 AS (SELECT k.caller, k.callee, 2 AS hop FROM k WHERE k.caller IN (SELECT callee FROM s1) AND k.callee NOT IN (SELECT callee FROM s1))
SELECT * FROM s1 UNION ALL SELECT * FROM s2""")
def graph_call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.call_chain(M.edges(spark, sf_dir), spark.createDataFrame([("customer:3",)], "id string"), 2)


@query("""WITH s AS (SELECT s_nationkey AS file, s_suppkey AS id, s_suppkey AS start, s_suppkey + 10 + s_suppkey % 7 AS "end" FROM supplier), p AS (SELECT c_nationkey AS file, c_custkey AS point_id, c_custkey % 110 AS line FROM customer)
SELECT point_id, id, "end" - start AS width FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY "end" - start, id) AS r FROM p JOIN s USING (file) WHERE line BETWEEN start AND "end") WHERE r = 1""")
def graph_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("start"), (F.col("s_suppkey") + 10 + F.col("s_suppkey") % 7).alias("end"))
    p = M.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 110).alias("line"))
    return G.enclosing(p, s)


@query("""WITH s AS (SELECT s_nationkey AS file, s_suppkey AS id, s_suppkey AS start, s_suppkey + 10 + s_suppkey % 7 AS "end" FROM supplier), p AS (SELECT c_nationkey AS file, c_custkey AS range_id, c_custkey % 110 AS lo, c_custkey % 110 + 4 AS hi FROM customer),
m AS (SELECT range_id, id, start >= lo AS inside, "end" - start AS width FROM p JOIN s USING (file) WHERE start <= hi AND "end" >= lo)
SELECT range_id, id, inside FROM (SELECT *, bool_or(inside) OVER (PARTITION BY range_id) AS has, row_number() OVER (PARTITION BY range_id, inside ORDER BY width, id) AS r FROM m) WHERE inside OR (NOT has AND r = 1)""")
def graph_changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("start"), (F.col("s_suppkey") + 10 + F.col("s_suppkey") % 7).alias("end"))
    lo = F.col("c_custkey") % 110
    p = M.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("range_id"), lo.alias("lo"), (lo + 4).alias("hi"))
    return G.overlapping(p, s)


@query("""WITH e AS (SELECT * FROM events) SELECT x.event_id, max_by(y.value, (y.ts, y.value)) AS signup_value FROM e x LEFT JOIN e y ON y.user_id = x.user_id AND y.event_type = 'signup' AND y.ts <= x.ts WHERE x.event_type = 'purchase' GROUP BY 1""")
def graph_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.table(spark, sf_dir, "events")
    right = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("signup_value"))
    return G.latest_before(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "at", "signup_value").select("event_id", "signup_value")


@query("""WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS call_id, p_name || p_size AS name, p_brand AS file, p_type AS container, l_linenumber AS arity FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT 'part:' || p_partkey AS id, p_name || p_size AS name, p_brand AS s_file, p_type AS s_container, p_size AS s_arity FROM part),
m AS (SELECT call_id, id, CASE WHEN file = s_file THEN 4 ELSE 0 END + CASE WHEN container = s_container THEN 5 ELSE 0 END + CASE WHEN arity = s_arity THEN 5 WHEN abs(arity - s_arity) = 1 THEN 3 ELSE 0 END AS score FROM c JOIN s USING (name)),
t AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS ties FROM (SELECT *, rank() OVER (PARTITION BY call_id ORDER BY score DESC) AS r FROM m) WHERE r = 1)
SELECT call_id, id, score, ties, CASE WHEN ties > 1 THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS confidence FROM t WHERE ties <= 4""")
def graph_resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.table(spark, sf_dir, "part")
    li, name = M.table(spark, sf_dir, "lineitem"), F.concat("p_name", F.col("p_size").cast("string"))
    calls = li.join(p.hint("merge"), li["l_partkey"] == p["p_partkey"]).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("call_id"), name.alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("container"), F.col("l_linenumber").alias("arity"))
    symbols = p.select(M.key("part", "p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("container"), F.col("p_size").alias("arity"))
    return G.resolve_names(calls, symbols)
