"""Document fingerprints: a threshold-scaled sketch of word shingles.

Every distinct shingle of five words whose hash lies below a fixed fraction of the hash range stays; where fewer
than a few hashes do (short texts), the least few stay instead. Both rules look at the hashes alone, so the
sketch of two texts together follows from theirs, and the containment of a short document in a very long one can be
estimated from the sketches. A fingerprint is the sorted list of the kept hashes (first 12 hex digits of MD5),
joined by commas; it is empty only where a text has no words. Only column expressions are used.

A row holds one text and its words at a time, whatever its length: memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm.common import shuffle_partitions

SPACE = r"[\x20\x09-\x0D]+"
DIGITS = 12
#: The fraction of the hash range that a sketch keeps, and how many hashes it has at least (where the text has them).
ONE_IN, LEAST = 8, 16
#: Stands for a null doc_id, so that the keys of the joins are never null.
NO_ID = -(1 << 63)


def shingle_list(text: Column, size: int = 5) -> Column:
    """All shingles of size words in lower case; with fewer words, the whole sequence as one; none without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    return F.transform(
        F.array(words),  # binds the words once
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>"))
        .when(F.size(w) < size, F.array(F.array_join(w, " ")))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))),
    )[0]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use() refers to it."""
    return F.transform(F.array(value), use)[0]


def limit(one_in: int = ONE_IN) -> str:
    """Hashes below this lie in the first 1/one_in of the range (one_in: a power of two up to 256)."""
    return f"{256 // one_in:02x}"


def _kept(hashes: Column, one_in: int, least: int) -> Column:
    """Of hashes: those below the limit, or the least few where fewer than that are."""

    def either(below: Column) -> Column:
        return F.when(F.size(below) >= least, F.sort_array(below)).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, least))

    return bound(F.array_distinct(F.filter(hashes, lambda h: h < limit(one_in))), either)


def fingerprint(text: Column, one_in: int = ONE_IN, size: int = 5, least: int = LEAST) -> Column:
    """The sketch of a text: its hashes below 1/one_in of the range, or its least few."""
    hashes = F.transform(shingle_list(text, size), lambda s: F.substring(F.md5(s), 1, DIGITS))
    return F.array_join(bound(hashes, lambda h: _kept(h, one_in, least)), ",")


def _hashes(mark: Column) -> Column:
    return F.when(mark == "", F.array().cast("array<string>")).otherwise(F.split(mark, ","))


def merge(a: Column, b: Column, one_in: int = ONE_IN, least: int = LEAST) -> Column:
    """The fingerprint of two texts' shingles together."""
    return F.array_join(bound(F.array_union(_hashes(a), _hashes(b)), lambda h: _kept(h, one_in, least)), ",")


def containment(a: Column, b: Column, one_in: int = ONE_IN, least: int = LEAST) -> Column:
    """Estimated share of the smaller document's shingles that the other has (0 to 1).

    Counted over the hashes up to which both sketches are complete: all, where a sketch has fewer than the least
    few; its last one, where it has just these; else the limit. Equal fingerprints give 1, those of two texts
    without words included; a text without words and another give 0, and so do texts without hashes in that range.
    """

    def end(x: Column) -> Column:
        few = F.when(F.size(x) < least, F.lit("g")).otherwise(F.element_at(x, -1))  # "g" is beyond all digits
        return F.when(F.size(F.filter(x, lambda h: h < limit(one_in))) >= least, F.lit(limit(one_in))).otherwise(few)

    def share(s: Column) -> Column:
        return bound(
            F.struct(F.filter(s["x"], lambda h: h <= s["end"]).alias("x"), F.filter(s["y"], lambda h: h <= s["end"]).alias("y")),
            lambda c: F.when(F.least(F.size(c["x"]), F.size(c["y"])) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(c["x"], c["y"])) / F.least(F.size(c["x"]), F.size(c["y"]))),
        )

    both = bound(F.struct(_hashes(a).alias("x"), _hashes(b).alias("y")), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), F.least(end(s["x"]), end(s["y"])).alias("end")))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(bound(both, share)).cast("double")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below key, by binary search in an expression."""

    def find(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), find(lo, mid)).otherwise(find(mid + 1, hi))

    return find(0, len(bounds))


def next_keys(keys: DataFrame, key: str, most_ranges: int = 256) -> DataFrame:
    """For distinct non-null keys: key and next_key, its successor in ascending order; after the last: the first.

    Keys are dealt into quantile ranges (at most most_ranges of them, bounds known to the driver), each range takes
    its own successors in a window, and a range's last key gets the first key of the next range that has any.
    """
    n = max(2, min(most_ranges, shuffle_partitions(keys)))
    quantiles = keys.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 1000)).first()[0] or []
    ranged = keys.withColumn("range", _bucket(F.col(key), sorted(set(quantiles))))
    firsts = ranged.groupBy("range").agg(F.min(key).alias("first")).orderBy("range").collect()
    after = {r["range"]: firsts[(i + 1) % len(firsts)]["first"] for i, r in enumerate(firsts)}
    jump = F.create_map(*[F.lit(x) for kv in after.items() for x in kv])[F.col("range")] if after else F.lit(None)
    w = Window.partitionBy("range").orderBy(key)
    return ranged.select(*keys.columns, F.coalesce(F.lead(key).over(w), jump).cast("long").alias("next_key"))


def edited_fingerprints(docs: DataFrame, one_in: int = ONE_IN, size: int = 5, least: int = LEAST) -> DataFrame:
    """Each document's fingerprint, and that of the text whose last quarter the next document's start replaces.

    Takes doc_id and text (null: empty); other columns are ignored. Returns doc_id, n_chars, edited (text),
    fingerprint, edited_fingerprint, next_fingerprint. The next document has the next larger doc_id (after the
    last: the first); where a doc_id has several texts, the least of them stands for it as the next document,
    and each row keeps a result of its own. A null doc_id comes before all others. An empty table gives no rows.

    The texts are shuffled once by doc_id (both joins reuse that exchange); a quarter of each text and its sketch
    travel to the document before. Rows without doc_id, however many, stay where they are: what they get is one row.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    keys = own.groupBy(F.coalesce("key", F.lit(NO_ID)).alias("key")).agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("most"))
    pairs = next_keys(keys, "key").withColumnRenamed("key", "to")
    marked = own.withColumn("fingerprint", fingerprint(F.col("text"), one_in, size, least))
    nameless, named = marked.where("key is null"), marked.where("key is not null").repartition("key")
    least_text = F.min(F.struct("text", "fingerprint")).alias("n")
    heads = named.groupBy("key").agg(least_text)
    some = not nameless.isEmpty()
    if some:
        heads = heads.unionByName(nameless.groupBy(F.lit(NO_ID).alias("key")).agg(least_text))
    sent = pairs.join(heads, pairs["next_key"] == heads["key"]).select("to", F.substring("n.text", F.lit(1), F.col("most")).alias("head"), F.col("n.fingerprint").alias("next_fingerprint"))
    rows = named.join(sent, named["key"] == sent["to"]).select("key", "text", "fingerprint", "head", "next_fingerprint")
    if some:  # what follows them is the document with the least doc_id, or the least of themselves
        first = own.agg(F.min("key")).first()[0]
        after = marked.where(F.col("key").isNull() if first is None else F.col("key") == first).groupBy(F.lit(NO_ID).alias("to")).agg(least_text)
        met = nameless.join(F.broadcast(after), F.coalesce(nameless["key"], F.lit(NO_ID)) == after["to"])  # one row
        rows = rows.unionByName(met.select("key", "text", "fingerprint", F.col("n.text").alias("head"), F.col("n.fingerprint").alias("next_fingerprint")))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("head", F.lit(1), quarter))
    return rows.select(F.col("key").alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint").withColumn("edited_fingerprint", fingerprint(F.col("edited"), one_in, size, least))
