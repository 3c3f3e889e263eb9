"""Uses of names in source text that no edge tells of: block comments and strings apart, production code first.

Whether a line lies in a block comment or a docstring depends on all lines above it. Each line is a transition between four
states (outside, and inside each of three kinds of blocks); transitions compose, so chunks of lines are composed on their own, the
chunks' transitions are scanned the same way, level by level, and each chunk then starts from its own state. No task
holds more than a chunk of a file, however long the file is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks that open a block and what closes it; how comments and package lines begin; files that hold no code. Fixed values.
BLOCKS = (("/*", "*/"), ('"""', '"""'), ("'''", "'''"))
COMMENTS = ("//", "/*", "*", "#", "--", '"""', "'''")
DECLARATIONS = ("package ",)
NO_CODE = (".md", ".json", ".lock", ".txt", ".rst", ".yml", ".yaml", ".toml", ".svg", ".html", ".css")
TEST_FILE = r"(?i)(?:^|/)(?:tests?|specs?|fixtures?)(?:/|$|[_.])|[_.](?:test|spec)s?\.[^/.]+$"
VENDORED_FILE = r"(?i)(?:^|/)(?:vendor|node_modules|third_party)/|\.min\.[a-z]+$|(?:^|/)@[^/]+--[^/]+\.js$"
CHUNK = 256


def transition(text: Column) -> Column:
    """What a line makes of each state: an array of four states, 0 outside, 1 to 3 inside the kinds of blocks."""
    t = F.ltrim(F.coalesce(text, F.lit("")))
    start = F.lit(0)
    for k, (mark, end) in reversed(list(enumerate(BLOCKS, 1))):
        start = F.when(t.startswith(mark), F.when(F.substring(t, len(mark) + 1, 1 << 30).contains(end), 0).otherwise(k)).otherwise(start)
    return F.array(start.cast("int"), *[F.when(t.contains(end), 0).otherwise(k).cast("int") for k, (_, end) in enumerate(BLOCKS, 1)])


def _states(rows: DataFrame, chunk: int) -> DataFrame:
    """file, at and state, the state before each of rows (file, at from 0, t) in order."""
    parted = rows.groupBy("file", F.floor(F.col("at") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("rows"))
    longest = rows.agg(F.max("at")).first()[0] or 0
    if longest < chunk:
        entered = parted.withColumn("start", F.lit(0))
    else:
        same = F.array(*[F.lit(k) for k in range(len(BLOCKS) + 1)])
        whole = F.aggregate("rows", same, lambda s, r: F.transform(s, lambda x: F.element_at(r["t"], x + 1)))
        above = _states(parted.select("file", F.col("chunk").alias("at"), whole.alias("t")), chunk)
        entered = parted.join(above.select("file", F.col("at").alias("chunk"), F.col("state").alias("start")), ["file", "chunk"])
    begin = F.struct(F.col("start").alias("s"), F.array().cast("array<int>").alias("out"))
    told = F.aggregate("rows", begin, lambda a, r: F.struct(F.element_at(r["t"], a["s"] + 1).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))["out"]
    return entered.select("file", F.explode(F.arrays_zip(F.col("rows.at").alias("at"), told.alias("state"))).alias("x")).select("file", "x.at", "x.state")


def block_lines(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """file and line of the lines (file, line from 1, text) that begin inside a block comment or docstring. Only states are shuffled, no texts."""
    rows = lines.select("file", (F.col("line") - 1).alias("at"), transition(F.col("text")).alias("t"))
    return _states(rows, chunk).where("state > 0").select("file", (F.col("at") + 1).alias("line"))


def held(points: DataFrame, spans: DataFrame, width: int = CHUNK) -> DataFrame:
    """For each point (file, line, top): inner, the last span (file, name, start, end) that starts at or above top and has no end above line; last, the last that starts there at all.

    An end of 0 is none; ties of start go to the greater name; inner and last are (start, name) or null. Points meet spans in pieces of width
    lines: those that start there or reach in; of the spans that started before a piece only the last, and the last without an end, go on.
    """
    cell = lambda c: F.floor(c / width)
    one = F.struct("start", "name")
    reach = F.when(F.col("end") == 0, cell(F.col("start"))).otherwise(F.greatest(cell(F.col("start")), cell(F.col("end"))))
    pieces = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), reach)))
    asked = points.select("file", cell(F.col("line")).alias("cell")).distinct()
    starts = spans.groupBy("file", cell(F.col("start")).alias("cell")).agg(F.max(one).alias("all"), F.max(F.when(F.col("end") == 0, one)).alias("open"))
    w = Window.partitionBy("file").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = starts.unionByName(asked, allowMissingColumns=True).groupBy("file", "cell").agg(F.max("all").alias("all"), F.max("open").alias("open"))
    before = cells.select("file", "cell", F.max("all").over(w).alias("all"), F.max("open").over(w).alias("open"))
    met = points.select("file", "line", "top", cell(F.col("line")).alias("cell")).distinct().join(pieces, ["file", "cell"], "left")
    above = F.col("start") <= F.col("top")
    found = met.groupBy("file", "cell", "line", "top").agg(F.max(F.when(above & ((F.col("end") == 0) | (F.col("end") >= F.col("line"))), one)).alias("inner"), F.max(F.when(above, one)).alias("last"))
    return found.join(before, ["file", "cell"]).select("file", "line", "top", F.greatest("inner", "open").alias("inner"), F.greatest("last", "all").alias("last"))


def text_references(lines: DataFrame, symbols: DataFrame, names: list[str], definitions: DataFrame, resolved: DataFrame, near: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """Uses of names in lines (file, line, text), one for each file and enclosing symbol: owner, file, line, tests, kind, near, place.

    symbols: file, name, line, end_line (0 or null: unknown). definitions: file, line of the names' own declarations; there only a call
    counts. resolved: file, line and owner of uses that edges tell of; those lines and owners are left out. kind: 0 a call on something,
    1 a bare call, 2 another mention. Comments, docstrings, package lines, quoted and package-qualified names are no uses; files
    without code and vendored ones are not read. place: production code first, then kinds, near files, files and lines.
    """
    either = "|".join(re.escape(n) for n in sorted(names))
    use, call, bare = rf"(?U)(?<!\w)(?:{either})(?!\w)", rf"(?:\.|::|->)\s*(?:{either})\s*[(<!]", rf"(?U)(?<![\w.])(?:{either})\s*\("
    qualified, quoted = rf"(?U)\w\.(?:{either})\.[A-Z*{{]", rf"([\"'`])(?:{either})\1"
    code = lines.where(~F.col("file").rlike(VENDORED_FILE) & ~F.lower("file").rlike(rf"(?:{'|'.join(map(re.escape, NO_CODE))})$"))
    t, bare_text = F.col("text"), F.ltrim("text")
    no_use = F.lit(False)
    for mark in COMMENTS + DECLARATIONS:
        no_use = no_use | bare_text.startswith(mark)
    count = lambda p: F.regexp_count(t, F.lit(p))
    hits = code.where(t.rlike(use) & ~no_use & (count(use) != count(qualified) + count(quoted)))
    kind = F.when(t.rlike(call), 0).when(t.rlike(bare), 1).otherwise(2)
    hits = hits.select("file", "line", kind.alias("kind"), F.coalesce(F.lit(False) if near is None else near, F.lit(False)).alias("near"))
    # states are needed in files with hits alone
    inside = block_lines(code.join(hits.select("file").distinct(), "file", "left_semi"), chunk)
    hits = hits.join(inside, ["file", "line"], "left_anti").join(resolved.select("file", "line").distinct(), ["file", "line"], "left_anti")
    own = definitions.select("file", "line").distinct().withColumn("defined", F.lit(True))
    hits = hits.join(own, ["file", "line"], "left").where("defined is null or kind = 0")
    spans = symbols.select("file", "name", F.col("line").alias("start"), F.coalesce("end_line", F.lit(0)).alias("end"))
    hits = hits.withColumn("top", F.col("line") - F.when(F.col("defined"), 1).otherwise(0))
    told = hits.join(held(hits, spans), ["file", "line", "top"], "left").withColumn("owner", F.coalesce("inner.name", "last.name", F.lit("")))
    told = told.where(~F.col("owner").isin(*names)).join(resolved.where("owner is not null").select("file", "owner").distinct(), ["file", "owner"], "left_anti")
    first = told.groupBy("file", "owner").agg(F.min(F.struct("line", "kind", "near")).alias("m")).select("owner", "file", "m.*")
    return first.withColumn("tests", F.col("file").rlike(TEST_FILE)).withColumn("place", F.struct("tests", "kind", (~F.col("near")).alias("far"), "file", "line"))
