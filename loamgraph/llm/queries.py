"""The queries opN_<name> over the given tables, and their SQL.

Each query gets its rows through its operator and derives the columns of its contract from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import chat_format, decontamination, filter_audit, fingerprints, html_extract, importance, jaccard_join, language_id, license_scan, lm_scoring, packing, toxicity, va_file
from loamgraph.llm.common import table

#: All control strings in one text, as the contract's conversation -1 has it.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from the formatted string."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], given.schema)
    messages = given.unionByName(probe).withColumn("parts", chat_format.text_parts(F.col("text")))
    done = chat_format.format_chats(messages)
    turns = chat_format.parse_turns(F.col("formatted"))
    back = done.select("*", turns.alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(column: str) -> str:
    """chat_format.escape() in SQL."""
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in chat_format.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '{PROBE}' UNION ALL SELECT -1, NULL, 1, 'assistant', '{PROBE}'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({len(chat_format.TURN) + len(chat_format.BODY) + len(chat_format.END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) AS formatted_chars
  FROM t GROUP BY conv_id, lone
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g"""


def _crc32_of_id() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from documents that are not held out."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_crc32_of_id() % 3 == 1, F.lit(False))
    model = language_id.fit_on(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole document, learned from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_crc32_of_id() % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit_on(docs, labels)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical digest of every whole document and the known licence that has it."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _replaced_sql(column: str, steps: list[tuple[str, str]]) -> str:
    """Nested global regular-expression replacements in SQL; quotes are doubled here."""
    out = column
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return out


def _canonical_sql(column: str) -> str:
    """license_scan.canonical() in SQL."""
    out = _replaced_sql(f"lower(coalesce({column}, ''))", [(license_scan.COPYRIGHT_LINE, " "), (r"[^\p{L}\p{N}]+", "  ")])
    out = f"'  ' || trim({out}) || '  '"
    for x, y in license_scan.SPELLINGS:
        out = f"replace({out}, ' {x.replace(' ', '  ')} ', ' {y.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _known_sql() -> str:
    rows = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in sorted(license_scan.known_texts()))
    return f"SELECT sha256({_canonical_sql('text')}) AS known, min(license_id) AS license_id FROM (VALUES {rows}) AS v(license_id, text) GROUP BY 1"


OP4_SQL = f"""
WITH k AS ({_known_sql()}),
d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256({_canonical_sql("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, n_chars, canonical_sha256, license_id FROM d LEFT JOIN k ON canonical_sha256 = known"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and the component of its links at a Jaccard similarity of 0.75."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least(min(r.b), s.doc_id), s.doc_id) AS component_id
FROM s LEFT JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that leak into documents: a row for each (doc_id, item_id)."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _marked_sql(column: str) -> str:
    """decontamination.marked_text() in SQL."""
    out = _replaced_sql(
        f"coalesce({column}, '')",
        [(r"[^\p{L}\p{N}.,;:!?%$€£]+", " "), (r"([\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+)", r"\1@\2"), (r"(@\p{Lu}\p{Ll}+ )(\p{Lu}\p{Ll}+)", r"\1@\2"),
         (r"([0-9])%", r"\1 percent "), (r"([0-9])[.,]([0-9])", r"\1_\2"), (r"([0-9])[.,]([0-9])", r"\1_\2"), (r"\$([0-9])", r"dollar \1"), (r"([0-9][0-9_]*)", r" #\1 ")],
    )
    out = f"{_replaced_sql(f'lower({out})', [(r'[^\p{L}\p{N}#@_]+', ' ')])} || ' '"
    out = f"trim({_replaced_sql(out, [(rf'(#[0-9_]+) ({'|'.join(decontamination.UNITS)}) ', r'\1 %\2 '), (r' (dollar|euro|pound) #', r' %\1 #')])})"
    words = "|".join(decontamination.NUMBER_WORDS)
    out = _replaced_sql(f"'  ' || replace({out}, ' ', '  ') || '  '", [(f"  ({words})  ({'|'.join(decontamination.UNITS)})  ", r"  #\1  %\2  "), (f" ({words}) ", r" #\1 ")])
    return f"trim(replace({out}, '  ', ' '))"


def _windows_sql(source: str, key: str) -> str:
    marked = _marked_sql("text")
    return f"""
  SELECT {key}, i AS pos, array_to_string(t[i:i+7], ' ') AS plain, m[i:i+7] AS slots FROM (
    SELECT {key}, t, m, unnest(range(1, greatest(len(t) - 7, 1) + 1)) AS i FROM (
      SELECT {key}, list_filter(string_split(marked, ' '), lambda x: x <> '') AS m,
        list_filter(string_split(regexp_replace(marked, '([#@%])[\\p{{L}}\\p{{N}}_]+', '\\1', 'g'), ' '), lambda x: x <> '') AS t
      FROM (SELECT {key}, {marked} AS marked FROM {source})) WHERE len(t) > 0)"""


OP6_SQL = f"""
WITH own AS (
  SELECT * FROM (SELECT item_id, pos AS item_pos, plain AS item_plain, slots AS item_slots FROM ({_windows_sql("benchmark", "item_id")}))
  WHERE 2 * len(list_filter(string_split(item_plain, ' '), lambda x: x NOT IN ('#', '@', '%'))) >= len(string_split(item_plain, ' '))
), totals AS (SELECT item_id, count(DISTINCT item_plain) AS item_windows FROM own GROUP BY 1),
mine AS ({_windows_sql("documents", "doc_id")}),
met AS (SELECT doc_id, item_id, pos - item_pos AS shift, item_plain, item_slots, slots FROM mine JOIN own ON plain = item_plain),
pairs AS (
  SELECT DISTINCT doc_id, item_id, shift, item_slots[k] AS a, slots[k] AS b FROM (SELECT *, unnest(range(1, len(item_slots) + 1)) AS k FROM met)
  WHERE substr(item_slots[k], 1, 1) IN ('#', '@', '%')
), lines AS (
  SELECT doc_id, item_id, shift, count(*) AS n_slots, count(DISTINCT a) AS n_values, count(*) FILTER (WHERE a <> b) AS changed FROM pairs GROUP BY ALL
), good AS (
  SELECT met.doc_id, met.item_id, item_plain, coalesce(n_slots, 0) AS n_slots, coalesce(changed, 0) AS changed
  FROM met LEFT JOIN lines ON met.doc_id IS NOT DISTINCT FROM lines.doc_id AND met.item_id = lines.item_id AND met.shift = lines.shift
  WHERE coalesce(n_slots, 0) = coalesce(n_values, 0)
), found AS (
  SELECT doc_id, item_id, count(DISTINCT item_plain) AS matched_windows, max(n_slots) AS n_slots, max(changed) AS changed_slots FROM good GROUP BY ALL
)
SELECT doc_id, item_id, item_windows, matched_windows, round(matched_windows / item_windows, 6) AS coverage, n_slots, changed_slots, changed_slots > 0 AS reparameterised
FROM found JOIN totals USING (item_id) WHERE matched_windows / item_windows >= 0.5"""


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of every document under the counts of all documents."""
    return lm_scoring.stupid_backoff(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), t AS (SELECT doc_id, w[i] AS w, CASE WHEN i = 1 THEN chr(1) ELSE w[i - 1] END AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT w, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT chr(1), count(*) FROM d WHERE len(w) > 0),
b AS (SELECT h, w, count(*) AS n FROM t GROUP BY 1, 2),
s AS (
  SELECT t.doc_id, CASE WHEN b.n >= 2 THEN ln(b.n / hu.n) ELSE ln(0.4 * wu.n / (SELECT count(*) FROM t)) END AS s, b.n < 2 AS back
  FROM t JOIN b ON t.h = b.h AND t.w = b.w JOIN u hu ON t.h = hu.w JOIN u wu ON t.w = wu.w
), g AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE back) AS n_backoff, sum(s) AS s FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(s, 0.0), 4)::DOUBLE AS log_score,
  round(s / n_tokens, 6)::DOUBLE AS mean_log_score
FROM d LEFT JOIN g USING (doc_id)"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness to each other and to the next document's."""
    done = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        F.round(fingerprints.containment(F.col("fingerprint"), F.col("edited_fingerprint")), 6).alias("near_edited"),
        F.round(fingerprints.containment(F.col("fingerprint"), F.col("next_fingerprint")), 6).alias("near_next"),
    )


def _hashes_sql(column: str) -> str:
    """The hashes of all shingles of a list of words, in SQL."""
    w = column
    shingles = f"CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < 5 THEN [array_to_string({w}, ' ')] ELSE list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i+4], ' ')) END"
    return f"list_distinct(list_transform({shingles}, lambda x: substr(md5(x), 1, {fingerprints.DIGITS})))"


def _kept_sql(column: str) -> str:
    """fingerprints.fingerprint() of a list of hashes, in SQL."""
    below = f"list_filter({column}, lambda h: h < '{fingerprints.limit()}')"
    return f"CASE WHEN len({below}) >= {fingerprints.LEAST} THEN list_sort({below}) ELSE list_sort({column})[1:{fingerprints.LEAST}] END"


def _words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _near_sql(x: str, y: str) -> str:
    """fingerprints.containment() of two sorted lists, in SQL."""
    ends = [f"CASE WHEN len(list_filter({c}, lambda h: h < '{fingerprints.limit()}')) >= {fingerprints.LEAST} THEN '{fingerprints.limit()}' WHEN len({c}) < {fingerprints.LEAST} THEN 'g' ELSE {c}[-1] END" for c in (x, y)]
    a, b = (f"list_filter({c}, lambda h: h <= least({', '.join(ends)}))" for c in (x, y))
    return f"CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN least(len({a}), len({b})) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect({a}, {b})) / least(len({a}), len({b})), 6)::DOUBLE END"


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nxt FROM documents
), e AS (
  SELECT *, length(text) AS n_chars, substr(text, 1, length(text) - length(text) // 4) || substr(nxt, 1, length(text) // 4) AS edited FROM d
), w AS (SELECT *, {_words_sql("text")} AS w0, {_words_sql("edited")} AS w1, {_words_sql("nxt")} AS w2 FROM e),
h AS (SELECT doc_id, n_chars, edited, {_hashes_sql("w0")} AS h0, {_hashes_sql("w1")} AS h1, {_hashes_sql("w2")} AS h2 FROM w),
f AS (SELECT doc_id, n_chars, edited, {_kept_sql("h0")} AS f0, {_kept_sql("h1")} AS f1, {_kept_sql("h2")} AS f2 FROM h)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(f0, ',') AS fingerprint, array_to_string(f1, ',') AS edited_fingerprint,
  {_near_sql("f0", "f1")} AS near_edited, {_near_sql("f0", "f2")} AS near_next
FROM f"""


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, by part, order and step."""
    return filter_audit.audit(filter_audit.failing_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN y USING (doc_id)
), g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
m AS (
  SELECT part, filter_order, step, substr(filter_order, step::INT, 1) AS filter, good, toxic, n, fails,
    len(replace(translate(fails, substr(filter_order, 1, step::INT - 1), ''), ' ', '')) < len(fails) AS before, contains(fails, substr(filter_order, step::INT, 1)) AS hit
  FROM g, s
), r AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN NOT before AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT before AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN before AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT before AND hit AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT before AND hit AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM m GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r"""


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors by integer inner product of every row whose vec_id is divisible by 50, against all rows."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return va_file.search(vectors, vectors.where("vec_id % 50 = 0"), k=5).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, q.v AS q, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND NOT (q.vec_id = c.vec_id AND q.v = c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC NULLS LAST, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight for the benchmark's distribution, its score, and its rank if it is drawn."""
    return importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


OP13_SQL = """
WITH RECURSIVE bits(i, b, k) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END, k + 1 FROM bits WHERE k < 8
), low AS (
  SELECT doc_id, row_number() OVER () AS row, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), target AS (
  SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), mine AS (
  SELECT row, f, count(*) AS n FROM (SELECT row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM low) GROUP BY ALL
), theirs AS (
  SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM target) GROUP BY 1
), names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM mine UNION SELECT f FROM theirs)),
steps(f, h, pos, c) AS (
  SELECT f, h, 0, 4294967295::BIGINT FROM names
  UNION ALL SELECT f, h, pos + 1, xor(c // 256, b) FROM steps JOIN bits ON k = 8 AND i = xor(c % 256, ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT) WHERE 2 * pos < len(h)
), hashed AS (SELECT f, (4294967295 - c) % 10000 AS bucket FROM steps WHERE 2 * pos = len(h)),
s AS (SELECT bucket, sum(n) AS s FROM mine JOIN hashed USING (f) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM theirs JOIN hashed USING (f) GROUP BY 1),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM s)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), sums AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM mine JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, row, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM low LEFT JOIN sums USING (row)
), placed AS (SELECT *, row_number() OVER (ORDER BY fit DESC, weight + noise DESC, doc_id NULLS LAST, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN fit AND place <= (SELECT 25 * count(*) // 100 FROM scored WHERE fit) THEN place END AS rank FROM placed"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_chat_format, op2_language_id, op3_toxicity, op4_license_scan, op5_ngram_jaccard_join, op6_benchmark_decontamination, op7_lm_scoring, op8_best_fit_packing, op9_document_fingerprints, op10_html_extraction, op11_filter_audit, op12_exact_topk, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    """SQL by query name, where SQL can express the whole result."""
    return {
        "op1_chat_format": OP1_SQL,
        "op4_license_scan": OP4_SQL,
        "op5_ngram_jaccard_join": OP5_SQL,
        "op6_benchmark_decontamination": OP6_SQL,
        "op7_lm_scoring": OP7_SQL,
        "op9_document_fingerprints": OP9_SQL,
        "op11_filter_audit": OP11_SQL,
        "op12_exact_topk": OP12_SQL,
        "op13_importance_resampling": OP13_SQL,
    }
