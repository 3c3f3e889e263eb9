"""Impact of a change: diffs to ranges and kinds of change, and how a change spreads over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators import traverse as T
from loamgraph.sources.model import CONSUMER_LABELS, STRUCTURAL

#: Suffixes by kind of change, and what shows a changed signature. Fixed values.
ASSET = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".mp3", ".wav", ".mp4", ".prefab", ".unity", ".asset")
CONFIGURATION = (".json", ".yaml", ".yml", ".toml", ".xml", ".csproj", ".sln", ".asmdef")
DOCUMENTATION = (".md", ".rst", ".txt")
SIGNATURE = r"\b(class|interface|struct|enum|public|protected|internal|def|func|fn)\b[^\n]*(\(|:)"


def change_types(path: Column, changed: Column) -> Column:
    """Kinds of change of a file by its suffix and its added and removed lines; logic where none applies."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    kinds = {"asset": suffix.isin(*ASSET), "configuration": suffix.isin(*CONFIGURATION), "documentation": suffix.isin(*DOCUMENTATION), "signature": F.coalesce(changed, F.lit("")).rlike(SIGNATURE)}
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("logic"))).otherwise(found)


def diff_files(lines: DataFrame) -> DataFrame:
    """Files of unified diffs (diff, no, line; no counts a diff's lines): diff, file, ranges (lo, hi of the new side) and types.

    A hunk that only removes has no range. Of each changed line the first 500 characters count.
    """
    w = Window.partitionBy("diff").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    of = F.last(F.when(line.startswith("+++ b/"), F.substring(line, 7, 1 << 30)), ignorenulls=True).over(w)
    hunk = line.startswith("@@")
    lo = F.regexp_extract(line, r"^@@.*?\+([0-9]+)", 1).try_cast("long")
    n = F.coalesce(F.regexp_extract(line, r"^@@.*?\+[0-9]+,([0-9]+)", 1).try_cast("long"), F.lit(1))
    changed = line.rlike("^[+-]") & ~line.rlike(r"^(\+\+\+|---)")
    told = lines.select("diff", "no", of.alias("file"), F.when(hunk & (n > 0), F.struct("no", lo.alias("lo"), (lo + n - 1).alias("hi"))).alias("range"), F.when(changed, F.struct("no", F.substring(line, 2, 500).alias("text"))).alias("edit"))
    files = told.where("file is not null").groupBy("diff", "file").agg(F.sort_array(F.collect_list("range")).alias("r"), F.sort_array(F.collect_list("edit")).alias("e"))
    text = F.array_join(F.transform("e", lambda x: x["text"]), "\n")
    return files.select("diff", "file", F.transform("r", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("ranges"), change_types(F.col("file"), text).alias("types"))


def depth(symbols: DataFrame) -> int:
    """How many hops a change of symbols (signature) is followed: three if a signature changed, else two."""
    return 2 if symbols.where("signature").isEmpty() else 3


def spread(edges: DataFrame, symbols: DataFrame, most: int, reasons: bool = True) -> DataFrame:
    """What a change of symbols (id) reaches within most hops: id, hop and, as reasons, via, label, confidence.

    To consumers, from a container to what it holds, and both ways along other relations.
    """
    consumer, held = F.col("label").isin(*CONSUMER_LABELS), F.col("label").isin(*STRUCTURAL)
    rest = ["label", "confidence"]
    view = edges.where(~held).select(F.col("target").alias("at"), F.col("source").alias("to"), *rest).unionByName(edges.where(~consumer).select(F.col("source").alias("at"), F.col("target").alias("to"), *rest))
    return (T.hops if reasons else T.reach)(view, symbols, most).where("hop > 0")


def capped(impacted: DataFrame, nodes: DataFrame, most: int = 250) -> DataFrame:
    """The first most impacted ids by hop, degree and name, with total and truncated on every row; nodes: id, name, degree."""
    met = impacted.join(nodes.select("id", "name", "degree"), "id", "left")
    total = impacted.agg(F.count("*").alias("total"))
    first = met.orderBy("hop", F.desc(F.coalesce("degree", F.lit(0))), F.coalesce("name", F.lit("")), "id").limit(most)
    return first.join(F.broadcast(total)).withColumn("truncated", F.col("total") > most)  # total: one row


def tests_apart(uses: DataFrame, is_test: Column) -> tuple[DataFrame, DataFrame]:
    """Uses (file) that are not in test files, and how many there are in each test file."""
    return uses.where(~is_test), uses.where(is_test).groupBy("file").agg(F.count("*").alias("uses"))
