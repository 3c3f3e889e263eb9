"""Target-distribution importance resampling over hashed n-grams, in DataFrame functions alone.

Every document's runs of one and two words are exploded and hashed to buckets (CRC-32 modulo a parameter). Grouped bucket
counts of all documents and of the target texts give each bucket a gain: a thousand times the logarithm of the ratio of
the two smoothed frequencies, floored. The gains, one row a bucket, are the broadcast side of a join with the exploded
n-grams; a document's weight is the floored mean of its gains. A Gumbel number fixed by a seed and the doc_id turns weights
into a draw without replacement: the highest scores are drawn. Ranks come from a range-partitioned sort: a row's place in
its partition plus the rows of all partitions before it.

Defined results: a null text has no words, a document without words has weight 0. A null doc_id is an empty string in the
hash and follows all others among equal scores. Repeated rows are documents of their own: equal scores, ranks side by side. An
empty table gives no rows, an empty target gives every bucket t = 0. A row holds one text and its n-grams at a time.
Only doc_id and text are read, so extra columns of any name do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.llm.common import materialise, shuffle_partitions
from loamgraph.llm.fingerprints import bound

#: What parts words: everything ASCII but digits and small letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000


def words(text: Column) -> Column:
    """The words of a text, A to Z lowered; none for a null text."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, GAP), lambda w: w != "")


def n_grams(text: Column) -> Column:
    """All runs of one and two words, repeats and all, each joined by a space."""
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return bound(words(text), lambda w: F.concat(w, pairs(w)))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    """A feature's bucket."""
    return (F.crc32(feature) % buckets).cast("int")  # of the UTF-8 bytes


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, how many features of all texts (text) fall into it: at most one row a bucket; counted before the shuffle."""
    return texts.select(F.explode(n_grams(F.col("text"))).alias("feature")).select(bucket(F.col("feature"), buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain for every bucket, from the counts of all docs (text) and of all target texts (text)."""
    counts = bucket_counts(docs, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    both = materialise(counts.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1.0) * F.lit(float(all_s + buckets)) / ((d("s") + 1.0) * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: DataFrame) -> DataFrame:
    """doc_id, n_features and weight, the floored mean gain, a row for each row of docs (doc_id, text).

    A row's number is used within the task that reads it, where its n-grams are summed before the shuffle: one row a
    document is shuffled. gain has one row a bucket, which bounds what is broadcast.
    """
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    each = own.select("doc_id", "row", F.explode_outer(n_grams(F.col("text"))).alias("feature"))
    buckets = gain.count()
    met = each.select("doc_id", "row", bucket(F.col("feature"), buckets).alias("bucket")).join(F.broadcast(gain), "bucket", "left")
    sums = met.groupBy("doc_id", "row").agg(F.count("bucket").alias("n_features"), F.sum("gain").alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    return sums.select("doc_id", "n_features", mean.cast("long").alias("weight"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel number, floored, fixed by the seed and the doc_id."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank, 1, 2, 3 ... in an order: places in sorted ranges plus the rows of all ranges before.

    The sorted rows are written once, as a second sort might draw other ranges. The offsets are one row a partition.
    """
    ranges = rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order)
    placed = materialise(ranges.withColumn("place", F.monotonically_increasing_id()), "ranked")
    split = placed.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = split.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return split.join(F.broadcast(sizes.select("range", before.alias("before"))), "range").withColumn("rank", F.col("before") + F.col("place") + 1).drop("range", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of docs (doc_id, text) for target texts (text).

    Of the documents with least_words words or more, percent in a hundred (floored) are drawn: the highest scores, ties
    to the smaller doc_id.
    """
    scored = weights(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialise(scored.withColumn("fit", F.col("n_features") >= max(2 * least_words - 1, 0)), "scored")
    drawn = percent * scored.where("fit").count() // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    out = ranked(scored, order)
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank")).cast("long").alias("rank"))
