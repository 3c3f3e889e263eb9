"""Bounded and filtered results: projections, first-N views, scopes, owners, injected context, pages, merges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import text as X
from loamgraph.functions.lineage import written

#: How captured instructions begin, and origins that are no evidence. Fixed values.
INJECTED_STARTS = ("# agents.md instructions for ", "<environment_context>")
INJECTED_ORIGINS = ("bootstrap", "evaluation", "memory_retrieval_request", "memory_retrieval_answer")
SHARED_MEMORY = ("memoria compartida", "shared memory")
RETRIEVAL_VERBS = ("consulta", "consult", "recupera", "retrieve")


def _any(text: Column, cues: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | text.contains(cue)
    return out


def in_named_scope(path: Column, namespace: Column, names: list[str]) -> Column:
    """Whether a node lies in a named component: one of its directories or of its namespace's parts has the name."""
    folders = F.split(F.lower(F.coalesce(path, F.lit(""))), "/")
    parts = F.concat(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0))), F.split(F.lower(F.coalesce(namespace, F.lit(""))), r"[.:\\]+"))
    return F.arrays_overlap(parts, F.array(*[F.lit(n.lower()) for n in names])) if names else F.lit(False)


def compact(nodes: DataFrame, keep: list[str], details: str = "details", most: int = 240) -> DataFrame:
    """The kept columns of nodes, and details cut to most characters, null where they only repeat a kept column."""
    repeats = F.lit(False)
    for c in keep:
        repeats = repeats | F.coalesce(F.col(c).cast("string") == F.col(details), F.lit(False))
    return nodes.select(*keep, F.when(~repeats, F.substring(details, 1, most)).alias(details))


def bounded(nodes: DataFrame, edges: DataFrame, order: list, most: int) -> DataFrame:
    """One row: how many of the first most nodes and of the edges between them (twice as many) a bounded result has, and how many are left out."""
    first = nodes.orderBy(*order).limit(most).select("id")
    ends = first.select(F.col("id").alias("source")), first.select(F.col("id").alias("target"))
    links = edges.join(F.broadcast(ends[0]), "source", "left_semi").join(F.broadcast(ends[1]), "target", "left_semi").agg(F.count("*").alias("all_links"))  # most rows each
    n = nodes.agg(F.count("*").alias("all_nodes"))
    kept, held = F.least(F.lit(most), F.col("all_nodes")), F.least(F.lit(2 * most), F.col("all_links"))
    return n.join(F.broadcast(links)).select(  # one-row sides
        kept.cast("long").alias("nodes"), (F.col("all_nodes") - kept).alias("nodes_truncated"), held.cast("long").alias("links"), (F.col("all_links") - held).alias("links_truncated")
    )


def map_view(nodes: DataFrame, edges: DataFrame, degrees: DataFrame, parent: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """The most connected nodes and the parents (an expression over a node's columns) they have, and the edges between them."""
    top = nodes.join(degrees.select("id", "degree"), "id").orderBy(F.desc("degree"), "id").limit(most)
    keep = top.select(F.explode(F.array(F.col("id"), parent)).alias("id")).where("id is not null").distinct()
    kept = nodes.join(F.broadcast(keep), "id", "left_semi")  # at most twice most ids
    between = edges.join(F.broadcast(keep.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(keep.withColumnRenamed("id", "target")), "target", "left_semi")
    return kept, between


def visible_topics(topics: DataFrame, episodes: DataFrame, owners: list[str] | None, private: bool) -> DataFrame:
    """Topics (topic) that a private store shows: none of their episodes (topic, agent) belongs to an agent outside the owners.

    Any topic outside private stores or with owners None; none where the owners are an empty list.
    """
    if not private or owners is None:
        return topics
    if not owners:
        return topics.where(F.lit(False))
    foreign = episodes.where(~F.lower(F.coalesce("agent", F.lit(""))).isin(*[o.lower() for o in owners])).select("topic").distinct()
    return topics.join(foreign, "topic", "left_anti")


def injected_context(text: Column, origin: Column, evaluation: Column, product: str = "loamgraph") -> Column:
    """Whether a message is captured instructions or an echo of retrieval, which is no evidence; a known origin decides."""
    start = F.substring(F.ltrim(F.lower(F.coalesce(text, F.lit("")))), 1, 8000)
    low, known = X.folded(start), F.lower(F.trim(F.coalesce(origin, F.lit(""))))
    shared = _any(low, SHARED_MEMORY)
    begins = start.startswith(INJECTED_STARTS[0]) | start.startswith(INJECTED_STARTS[1]) | (start.startswith("<instructions>") & start.contains("agents.md"))
    request = low.contains(product) & shared & _any(low, RETRIEVAL_VERBS)
    echo = request | (shared & low.contains("message_id")) | begins
    return F.coalesce(evaluation, F.lit(False)) | known.isin(*INJECTED_ORIGINS) | ((known == "") & echo)


def one_per_name(rows: DataFrame, name: str, order: list, most: int) -> DataFrame:
    """The first row of each name, then the rest, each in the given order: the first most rows, with their place."""
    first = F.row_number().over(Window.partitionBy(name).orderBy(*order)) > 1
    placed = rows.withColumn("again", first).orderBy("again", *order).limit(most)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("again", *order)))  # at most most rows


def page_with_next(rows: DataFrame, order: list, offset: int, count: int) -> DataFrame:
    """One page in a total order, with next_offset on each row: null on the last page. One row more than the page is read."""
    more = rows.orderBy(*order).offset(offset).limit(count + 1)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)  # at most count + 1 rows
    placed = more.withColumn("place", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return placed.where(F.col("place") <= count).withColumn("next_offset", F.when(F.col("n") > count, F.lit(offset + count).cast("long"))).drop("n", "place")


def federated(stores: dict[str, DataFrame], most: int) -> DataFrame:
    """The best rows (id, score, at) of several stores, each cut to most before they meet: store, id, score, at."""
    out = None
    for name, rows in stores.items():
        one = rows.select(F.lit(name).alias("store"), "id", "score", "at").orderBy(F.desc("score"), F.desc("at"), "id").limit(most)
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("score"), F.desc("at"), "store", "id").limit(most)


def merge_store(primary: DataFrame, secondary: DataFrame, key: str = "id") -> DataFrame:
    """All rows of primary, and those of secondary whose key primary lacks: ids stay, conflicts are left as they are."""
    return primary.unionByName(secondary.dropDuplicates([key]).join(primary.select(key), key, "left_anti").select(*primary.columns))


def consolidate(source: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a resumed copy does with each source row (id, digest): copied, skipped (in the ledger as it is) or conflict (with another digest)."""
    met = source.join(ledger.select("id", F.col("digest").alias("done")), "id", "left")
    return met.withColumn("action", F.when(F.col("done").isNull(), "copied").when(F.col("done") == F.col("digest"), "skipped").otherwise("conflict")).drop("done")


def reused_facts(old: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """path and reused of new files (path, digest): whether old facts (path, digest, version) hold for the same digest and parser version."""
    same = old.where(F.col("version") == version).select("path", "digest", F.lit(True).alias("hit")).distinct()
    return new.join(same, ["path", "digest"], "left").select("path", F.coalesce("hit", F.lit(False)).alias("reused"))


def tokens_avoided(file_bytes: Column, payload_bytes: Column) -> Column:
    """Tokens of whole files over those of a payload, at four bytes each, not below 0."""
    return F.greatest(F.lit(0), F.floor(file_bytes / 4) - F.floor(payload_bytes / 4)).cast("long")


def source_history_tokens(bundles: DataFrame, citations: DataFrame, messages: DataFrame) -> DataFrame:
    """Tokens of the history behind each bundle of memories: of the messages it cites, else of its sessions.

    bundles: bundle, session; citations: bundle, session, seq; messages: session, seq, content.
    """
    cost = messages.select("session", "seq", X.token_estimate(F.col("content")).alias("cost"))
    cited = citations.distinct().join(cost, ["session", "seq"]).groupBy("bundle").agg(F.sum("cost").alias("cited"))
    citing = citations.select("bundle").distinct().withColumn("cites", F.lit(True))
    per_session = cost.groupBy("session").agg(F.sum("cost").alias("cost"))
    whole = bundles.distinct().join(per_session, "session", "left").groupBy("bundle").agg(F.sum("cost").alias("whole"))
    met = whole.join(citing, "bundle", "left").join(cited, "bundle", "left")
    return met.select("bundle", F.coalesce(F.when(F.col("cites"), F.col("cited")).otherwise(F.col("whole")), F.lit(0)).alias("tokens"))


def relevance(query_terms: Column, text_terms: Column, identifiers: Column) -> Column:
    """struct(overlap, semantic_bonus, identifier_bonus) of a text's distinct terms for a query's."""
    overlap = F.size(F.array_intersect(query_terms, text_terms))
    bonus = F.least(F.lit(0.08), overlap / F.greatest(F.lit(1), F.size(query_terms)) * 0.12)
    named = F.coalesce(F.arrays_overlap(identifiers, text_terms), F.lit(False))
    return F.struct(overlap.alias("overlap"), F.round(bonus, 6).alias("semantic_bonus"), F.when(named, 0.08).otherwise(0.0).alias("identifier_bonus"))


def plain_query(nodes: DataFrame, query: str, details: str = "container") -> DataFrame:
    """Nodes whose name or details hold the query, whatever the case."""
    q = query.lower()
    return nodes.where(F.lower("name").contains(q) | F.lower(F.coalesce(F.col(details), F.lit(""))).contains(q))


def overview_quality(flags: list[Column]) -> Column:
    """The share of presence flags that hold."""
    return F.round(sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0)) / len(flags), 4)


def _whole_word(name: str) -> str:
    """A pattern for a name, plain text, as a whole word."""
    return rf"(^|[^A-Za-z0-9_]){re.escape(name)}($|[^A-Za-z0-9_])"


def identifier_hits(lines: DataFrame, names: list[str], most: int = 3) -> DataFrame:
    """The first most lines (file, line, text) that have each name as a whole word: name, file, line. Names are plain text, not patterns."""
    found = F.filter(F.array(*[F.when(F.col("text").rlike(_whole_word(n)), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    hits = lines.select("file", "line", F.explode(found).alias("name"))
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("file", "line"))).where(F.col("place") <= most).select("name", "file", "line")


def identifier_hits_in(files: DataFrame, names: list[str], most: int = 3) -> DataFrame:
    """identifier_hits() of files (file, text): only files that can have one of a name's first most hits are cut into lines.

    A whole text has a name as a whole word where one of its lines has it, as a line's end is no part of a word.
    """
    told = [F.when(F.col("text").contains(n) & F.col("text").rlike(_whole_word(n)), F.lit(n)) for n in names]
    found = files.select("file", F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("name"))
    ranked = found.withColumn("before", F.rank().over(Window.partitionBy("name").orderBy("file"))).where(F.col("before") <= most)
    first = written(ranked.select("file").distinct(), "files")  # its size is known, so few are broadcast and no text is shuffled
    lines = files.join(first, "file", "left_semi").select("file", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("file", (F.col("i") + 1).cast("long").alias("line"), "text")
    return identifier_hits(lines, names, most)


def selection_reason(hop: Column, matched: Column) -> Column:
    """Why a node was chosen: the terms it shares with the request, the relation to one that does, or the index."""
    return F.when(matched > 0, "shared terms").when(hop > 0, "relation").otherwise("index")


def guardrails(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """Metrics (one row) as rows metric, value, threshold, passed."""
    cells = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("threshold")) for k, v in least.items()]
    return metrics.select(F.explode(F.array(*cells)).alias("c")).select("c.*").withColumn("passed", F.col("value") >= F.col("threshold"))
