"""Benchmark decontamination by template windows.

Numbers, names and units of a text become typed placeholders; windows of canonical tokens of documents and
benchmark items are joined by hash and compared; the values that stand at the placeholders must map
consistently from item to document along an alignment, which also catches questions with other parameters.
Only column expressions are used. A bitmap of the items' window hashes (fixed size) drops a document's other
windows before anything is exploded, so what is shuffled follows the number of matches and not of windows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import materialise

#: Units after a number. Fixed values.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams "
    "kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes l ml liter liters litre litres gallon gallons s ms sec second seconds min minute minutes h hr hour hours day "
    "days week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp kmh mph kph kw kwh w v hz khz mhz ghz kb mb gb tb degree degrees"
).split()
#: Words that stand for numbers. Fixed values.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "million billion dozen half twice thrice"
).split()
#: What parts tokens once marks are set.
PARTING = r"[^\p{L}\p{N}#@_]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use() refers to it; inside lambdas Spark shares nothing by itself."""
    return F.transform(F.array(value), use)[0]


def marked_text(text: Column) -> Column:
    """Tokens between single spaces in lower case; "#", "@" or "%" stands before each number, name or unit.

    A name is a capitalised word inside a sentence; a number is digits or a number word. Everything but letters and
    digits parts tokens.
    """

    def with_words(out: Column) -> Column:
        # a match begins at a blank and one of few letters, so other places are passed over at once
        first = "".join(sorted({w[0] for w in NUMBER_WORDS}))
        out = F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), rf" (?=[{first}])({'|'.join(NUMBER_WORDS)})(?= )", " #$1")
        return F.trim(F.regexp_replace(out, rf"#([a-z]+) ({'|'.join(UNITS)})(?= )", "#$1 %$2"))

    def with_numbers(out: Column) -> Column:
        num = F.regexp_replace(out, r"([0-9])%", "$1 percent ")
        num = F.regexp_replace(num, r"([0-9])[.,](?=[0-9])", "$1_")
        num = F.regexp_replace(num, r"\$([0-9])", "dollar $1")
        num = F.regexp_replace(num, r"([0-9][0-9_]*)", " #$1 ")
        num = F.concat(F.regexp_replace(F.lower(num), PARTING, " "), F.lit(" "))
        return F.regexp_replace(F.regexp_replace(num, rf"(#[0-9_]+) ({'|'.join(UNITS)}) ", "$1 %$2 "), r" (dollar|euro|pound) #", " %$1 #")

    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}.,;:!?%$€£]+", " ")
    out = F.regexp_replace(out, r"\p{Lu}(?<=[\p{L}\p{N},;:] \p{Lu})\p{Ll}+", "@$0")
    return with_words(F.trim(bound(out, lambda o: F.when(o.rlike("[0-9]"), with_numbers(o)).otherwise(F.regexp_replace(F.lower(o), PARTING, " ")))))


def tokens(marked: Column) -> Column:
    return F.when(marked == "", F.array().cast("array<string>")).otherwise(F.split(marked, " "))


def template(marked: Column) -> Column:
    """The marked text with every placeholder's value removed."""
    return F.regexp_replace(marked, r"([#@%])[\p{L}\p{N}_]+", "$1")


def _bare(marked: Column) -> Column:
    """Marked text without its marks: its tokens are alike wherever the words stand."""
    return F.translate(marked, "#@%", "")


def _runs(of: Column, width: int, exact: bool) -> Column:
    """The hash of every run of width tokens, by start: of two shorter runs' hashes, so a token is hashed once.

    Runs of bare tokens (exact) have hashes of their own, so they meet no template.
    """

    def joined(apart: int) -> Callable[[Column], Column]:
        def pairs(h: Column) -> Column:
            n = F.size(h) - F.lit(apart)
            return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + F.lit(apart))))).otherwise(F.array().cast("array<bigint>"))

        return pairs

    out, have = F.transform(of, lambda t: F.xxhash64(F.lit("="), t) if exact else F.xxhash64(t)), 1
    while have < width:
        apart = min(have, width - have)
        out, have = bound(out, joined(apart)), have + apart
    return out


WINDOWS = "array<struct<pos:int,hash:bigint,plain:string,slots:array<string>,exact:boolean>>"


def _windows(marked: Column, width: int, exact: bool, keep: Callable[[Column], Column] | None = None) -> Column:
    """All windows of width tokens of a marked text (a bound column); keep(hash) drops some before they are written out.

    plain is the template, or "=" and the bare tokens (exact), which no template has.
    """

    def written(hashes: Column) -> Column:
        at = F.transform(hashes, lambda h, i: F.struct((i + 1).alias("pos"), h.alias("hash")))
        at = at if keep is None else F.filter(at, lambda w: keep(w["hash"]))

        def plain(of: Column, pos: Column) -> Column:
            out = F.array_join(F.slice(of, pos, width), " ")
            return F.concat(F.lit("= "), out) if exact else out

        def whole(b: Column) -> Column:
            return F.transform(at, lambda w: F.struct(w["pos"].alias("pos"), w["hash"].alias("hash"), plain(b["of"], w["pos"]).alias("plain"), F.slice(b["m"], w["pos"], width).alias("slots"), F.lit(exact).alias("exact")))

        found = bound(F.struct(tokens(own).alias("of"), tokens(marked).alias("m")), whole)
        return found if keep is None else F.when(F.exists(hashes, keep), found).otherwise(F.array().cast(WINDOWS))

    own = _bare(marked) if exact else template(marked)
    return bound(_runs(tokens(own), width, exact), written)


def _item_windows(marked: Column, width: int, whole: bool) -> Column:
    """Windows of an item (a bound marked text), each with window: what coverage counts.

    Telling template windows; an item that has none, or is a window of its own for lack of tokens (whole), has
    windows of bare tokens too. The two windows of such a short item count as one.
    """

    def both(told: Column) -> Column:
        exact = _windows(marked, width, True)
        return F.concat(told, exact) if whole else F.when(F.size(told) == 0, exact).otherwise(told)

    found = bound(F.filter(_windows(marked, width, False), lambda w: _telling(w["plain"])), both)
    return F.transform(found, lambda w: w.withField("window", template(marked) if whole else w["plain"]))


def _telling(plain: Column) -> Column:
    """Whether at most half of a window's tokens are placeholders."""
    n = F.size(F.split(plain, " "))
    return (n - F.size(F.filter(F.split(plain, " "), lambda t: t.isin("#", "@", "%")))) * 2 >= n


def _in_bitmap(own: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash may be one of own's: a bitmap of 16 bits or more a window, of 2^20 to 2^24 bits.

    With more windows than 2^20 it lets more through, and the join decides; nothing else changes.
    """
    bits = 1 << min(24, max(20, (16 * own.count()).bit_length()))
    place = lambda h: F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")
    words = own.groupBy(place(F.col("hash")).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 AS int))")).alias("bits"))
    set_bits = {r["word"]: r["bits"] for r in words.collect()}
    bitmap = F.split(F.lit(",".join(str(set_bits.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")  # one literal; folded once
    return lambda h: F.getbit(F.get(bitmap, place(h)), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 8, least_coverage: float = 0.5) -> DataFrame:
    """Documents (doc_id, text) that contain benchmark items (item_id, text), as they are or with other parameters.

    Returns a row a leak: doc_id, item_id, item_windows, matched_windows, coverage, n_slots, changed_slots,
    reparameterised. An item leaks into a document if at least least_coverage of its distinct windows occur there
    on alignments (document position minus item position) where each slot value of the item has one value in
    the document. An item with fewer tokens than width is one window, looked for at every place of a document.
    Windows of mostly placeholders tell nothing and are not counted; an item that has no other ones is looked for
    word for word (windows of its tokens with their values), and so is, besides, an item with fewer tokens than
    width, whose first word may be taken for a name inside a document. Null and empty texts match nothing; rows
    with a repeated doc_id count as one document, and repeated item_ids as one item. Other columns are ignored.
    """
    of = materialise(items.select("item_id", marked_text(F.col("text")).alias("marked")).withColumn("n", F.least(F.size(tokens(F.col("marked"))), F.lit(width))), "items")

    def cut(n: int) -> DataFrame:
        return of.where(F.col("n") == n).select("item_id", F.explode(bound(F.col("marked"), lambda m: _item_windows(m, n, n < width))).alias("w"))

    lengths = {width, *(r["n"] for r in of.where("n > 0").select("n").distinct().collect())}
    own = functools.reduce(DataFrame.unionByName, map(cut, sorted(lengths)))
    own = materialise(own.select("item_id", F.col("w.pos").alias("item_pos"), "w.hash", F.col("w.plain").alias("item_plain"), F.col("w.slots").alias("item_slots"), "w.exact", "w.window"), "windows")
    totals = own.groupBy("item_id").agg(F.countDistinct("window").alias("item_windows"))
    widths = [(width, False), *((r["n"], r["exact"]) for r in own.select("exact", F.size("item_slots").alias("n")).distinct().collect())]
    keep = _in_bitmap(own)
    found = bound(marked_text(F.col("text")), lambda m: F.concat(*[_windows(m, k, exact, keep) for k, exact in sorted(set(widths))]))
    mine = docs.select("doc_id", F.explode(found).alias("w")).select("doc_id", "w.pos", "w.hash", "w.plain", "w.slots")
    met = mine.join(own, (mine["hash"] == own["hash"]) & (mine["plain"] == own["item_plain"])).select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "window", "item_slots", F.when(F.col("exact"), F.col("item_slots")).otherwise(F.col("slots")).alias("slots"))
    pairs = F.filter(F.arrays_zip("item_slots", "slots"), lambda s: F.substring(s["item_slots"], 1, 1).isin("#", "@", "%"))
    lines = met.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set("window").alias("plains"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    values = F.array_distinct(F.transform("pairs", lambda s: s["item_slots"]))
    changed = F.size(F.filter("pairs", lambda s: s["item_slots"] != s["slots"]))
    good = lines.where(F.size(values) == F.size("pairs")).select("doc_id", "item_id", F.explode("plains").alias("plain"), F.size("pairs").alias("n_slots"), changed.alias("changed"))
    found = good.groupBy("doc_id", "item_id").agg(
        F.countDistinct("plain").alias("matched_windows"), F.max("n_slots").cast("long").alias("n_slots"), F.max("changed").cast("long").alias("changed_slots")
    )
    return (
        found.join(totals, "item_id")
        .withColumn("coverage", F.col("matched_windows") / F.col("item_windows"))
        .where(F.col("coverage") >= least_coverage)
        .select("doc_id", "item_id", "item_windows", "matched_windows", F.round("coverage", 6).alias("coverage"), "n_slots", "changed_slots", (F.col("changed_slots") > 0).alias("reparameterised"))
    )


def drop_leaks(docs: DataFrame, items: DataFrame, width: int = 8, least_coverage: float = 0.5, most_broadcast: int = 200_000) -> DataFrame:
    """The rows of docs, all their columns unchanged, into which no item leaks.

    Rows with a repeated doc_id share its fate; so do all rows with a null doc_id. The leaking ids are broadcast up
    to most_broadcast of them; beyond that both sides are shuffled.
    """
    none = F.lit(-(1 << 63))
    bad = materialise(find_leaks(docs, items, width, least_coverage).select(F.coalesce(F.col("doc_id").cast("long"), none).alias("_leak")).distinct(), "leaks")
    side = F.broadcast(bad) if bad.count() <= most_broadcast else bad
    return docs.join(side, F.coalesce(docs["doc_id"].cast("long"), none) == side["_leak"], "left_anti")
