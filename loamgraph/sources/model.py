"""The relations of the model, projected from the given tables.

nodes(id, kind, name, file, line, container) and edges(source, target, label, confidence, file, line, candidates,
resolution_score) come from the star schema; messages, observations and memories from the text and event tables.
Every projection is a plain select or union, so filters and columns are pushed into the scans below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names that stand for a relation's kind of use. Fixed values.
CONTAINS, USES, CREATES, SUPPLIES = "contains", "uses", "creates", "supplies"
STRUCTURAL = ("contains", "declares")
CONSUMER_LABELS = (USES, CREATES)
CONFIDENCE_RANK = {"AMBIGUOUS": 0, "INFERRED": 1, "EXTRACTED": 2, "REVIEWED": 3, "TYPED": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, column: str) -> Column:
    """A node id: kind, colon, key."""
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the star schema."""
    t = lambda name: table(spark, sf_dir, name)

    def shape(df: DataFrame, kind: str, k: str, name: Column, file: Column, container: Column) -> DataFrame:
        return df.select(key(kind, k).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), file.alias("file"), F.col(k).cast("long").alias("line"), container.alias("container"))

    segment = F.when(F.col("c_mktsegment") == "BUILDING", "tests").when(F.col("c_mktsegment") == "MACHINERY", "legacy").otherwise("src")
    parts = [
        shape(t("region"), "region", "r_regionkey", F.col("r_name"), F.lit("src/region"), F.lit("world")),
        shape(t("nation"), "nation", "n_nationkey", F.col("n_name"), F.concat(F.lit("src/nation/"), F.col("n_regionkey").cast("string")), F.lit("world")),
        shape(t("customer"), "customer", "c_custkey", F.col("c_name"), F.concat(segment, F.lit("/customer/"), F.col("c_nationkey").cast("string")), F.col("c_mktsegment")),
        shape(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), F.concat(F.lit("src/supplier/"), F.col("s_nationkey").cast("string")), F.lit("suppliers")),
        shape(t("part"), "part", "p_partkey", F.col("p_name"), F.concat(F.lit("src/part/"), F.col("p_brand")), F.col("p_type")),
        shape(t("orders"), "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.concat(F.lit("src/order/"), F.col("o_orderstatus")), F.col("o_orderpriority")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES_SQL = """
SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS name, 'src/region' AS file, CAST(r_regionkey AS BIGINT) AS line, 'world' AS container FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'src/nation/' || n_regionkey, CAST(n_nationkey AS BIGINT), 'world' FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'tests' WHEN c_mktsegment = 'MACHINERY' THEN 'legacy' ELSE 'src' END || '/customer/' || c_nationkey, c_custkey, c_mktsegment FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'src/supplier/' || s_nationkey, s_suppkey, 'suppliers' FROM supplier
UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'src/part/' || p_brand, p_partkey, p_type FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'order', 'order ' || o_orderkey, 'src/order/' || o_orderstatus, o_orderkey, o_orderpriority FROM orders"""


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges order -> part of lineitem, repeated as the lines are."""
    li = table(spark, sf_dir, "lineitem")
    level = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("AMBIGUOUS")
    return li.select(
        key("order", "l_orderkey").alias("source"), key("part", "l_partkey").alias("target"), F.lit(USES).alias("label"), level.alias("confidence"),
        F.col("l_linestatus").alias("file"), F.col("l_linenumber").cast("long").alias("line"), F.lit(1).cast("long").alias("candidates"), F.lit(0.0).alias("resolution_score"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges of the star schema, not yet deduplicated."""
    t = lambda name: table(spark, sf_dir, name)

    def shape(df: DataFrame, a: Column, b: Column, label: str, candidates: Column | None = None) -> DataFrame:
        return df.select(
            a.alias("source"), b.alias("target"), F.lit(label).alias("label"), F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"),
            (F.lit(1) if candidates is None else candidates).cast("long").alias("candidates"), F.lit(0.0).alias("resolution_score"),
        )

    # one shuffle by part: pairs are then distinct within a partition, and the count falls away where candidates are not read;
    # the partitions' number is told, else small packed ones are joined to one whose pairs, unpacked, take gigabytes
    lines = t("lineitem").select("l_suppkey", "l_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_partkey").distinct()
    supplies = lines.withColumn("n", F.count("*").over(Window.partitionBy("l_partkey")))
    return (
        uses(spark, sf_dir)
        .unionByName(shape(t("nation"), key("region", "n_regionkey"), key("nation", "n_nationkey"), CONTAINS))
        .unionByName(shape(t("customer"), key("nation", "c_nationkey"), key("customer", "c_custkey"), CONTAINS))
        .unionByName(shape(t("supplier"), key("nation", "s_nationkey"), key("supplier", "s_suppkey"), CONTAINS))
        .unionByName(shape(t("orders"), key("customer", "o_custkey"), key("order", "o_orderkey"), CREATES))
        .unionByName(shape(supplies, key("supplier", "l_suppkey"), key("part", "l_partkey"), SUPPLIES, F.col("n")))
    )


USES_SQL = """
SELECT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target, 'uses' AS label,
  CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence,
  l_linestatus AS file, CAST(l_linenumber AS BIGINT) AS line, 1::BIGINT AS candidates, 0.0::DOUBLE AS resolution_score FROM lineitem"""

EDGES_SQL = f"""{USES_SQL}
UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'contains', 'EXTRACTED', NULL, NULL, 1, 0.0 FROM nation
UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 'EXTRACTED', NULL, NULL, 1, 0.0 FROM customer
UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 'EXTRACTED', NULL, NULL, 1, 0.0 FROM supplier
UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'creates', 'EXTRACTED', NULL, NULL, 1, 0.0 FROM orders
UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', 'EXTRACTED', NULL, NULL, count(*) OVER (PARTITION BY l_partkey), 0.0
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored messages: session, seq, agent, role, content; system messages are never stored."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return c.select(
        F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.concat(F.lit("agent"), (F.col("conv_id") % 4).cast("string")).alias("agent"), "role", F.col("text").alias("content")
    )


MESSAGES_SQL = "SELECT conv_id AS session, turn AS seq, 'agent' || (conv_id % 4) AS agent, role, text AS content FROM conversations WHERE role <> 'system'"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories: a row a document; status from its labels, digest of its text."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "contested").when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "quarantined").otherwise("observed")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("agent"), F.col("lang").alias("kind"), F.when(F.col("doc_id") % 10 == 0, "private").otherwise("shared").alias("scope"),
        status.alias("status"), F.col("text").alias("content"), F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), (F.col("doc_id") % 50).alias("session"),
    )


MEMORIES_SQL = """
SELECT d.doc_id AS id, d.source AS agent, d.lang AS kind, CASE WHEN d.doc_id % 10 = 0 THEN 'private' ELSE 'shared' END AS scope,
  CASE WHEN toxic = 1 THEN 'contested' WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'quarantined' ELSE 'observed' END AS status,
  d.text AS content, sha256(d.text) AS digest, d.doc_id % 50 AS session
FROM documents d LEFT JOIN labels l USING (doc_id)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: the event log, its payload kept as JSON text."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), "ts", F.col("event_type").alias("action"), "value", F.col("props").alias("details"))


OBSERVATIONS_SQL = "SELECT event_id AS id, user_id AS session, ts, event_type AS action, value, props AS details FROM events"
