"""Snippets of texts: the few windows around terms that show most of them within a number of characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters shown before and after a term, and the gap up to which two windows become one. Fixed values.
BEFORE, AFTER, GAP = 100, 230, 40
_WINDOW = "struct<start:int,stop:int,at:array<struct<at:int,bit:bigint>>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use() refers to it."""
    return F.transform(F.array(value), use)[0]


def windows(text: Column, terms: list[str]) -> Column:
    """The windows around the first place of each term in a text, joined where they meet: start, stop and the terms' places with a bit each."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*[F.struct((F.instr(low, t.lower()) - 1).alias("at"), F.lit(1 << k).cast("bigint").alias("bit")) for k, t in enumerate(terms)])
    anchors = F.array_sort(F.filter(found, lambda a: a["at"] >= 0))

    def add(done: Column, a: Column) -> Column:
        one = F.struct(F.greatest(F.lit(0), a["at"] - BEFORE).alias("start"), F.least(F.length(low), a["at"] + AFTER).alias("stop"), F.array(a).alias("at"))
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], one["stop"]).alias("stop"), F.concat(last["at"], F.array(a)).alias("at"))
        meets = F.coalesce(one["start"] <= last["stop"] + GAP, F.lit(False))
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(anchors, F.array().cast(f"array<{_WINDOW}>"), add)


def best_spans(text: Column, terms: list[str], budget: int = 640, most: int = 3) -> Column:
    """At most most windows (start, stop) that together show most of up to 12 terms within budget characters, in order of place.

    Of equal choices the one with fewer characters, then the one whose windows come first. A window longer than the budget is cut to
    it and shows the terms that begin in it. The choice is a fold over the windows that holds every set of most windows and fewer that
    fits: with one window a term these are few hundreds. No term in the text: the beginning.
    """
    if len(terms) > 12:
        raise ValueError("at most 12 terms")
    length = F.length(F.coalesce(text, F.lit("")))

    def cut(w: Column) -> Column:
        stop = F.least(w["stop"], w["start"] + budget)
        mask = F.aggregate(w["at"], F.lit(0).cast("bigint"), lambda m, a: F.when(a["at"] < stop, m.bitwiseOR(a["bit"])).otherwise(m))
        return F.struct(w["start"].alias("start"), stop.alias("stop"), mask.alias("mask"))

    none = F.struct(F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("mask"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def extend(sets: Column, w: Column) -> Column:
        fits = F.filter(sets, lambda s: (F.size(s["spans"]) < most) & (s["size"] + w["stop"] - w["start"] <= budget))
        more = F.transform(fits, lambda s: F.struct((s["size"] + w["stop"] - w["start"]).alias("size"), s["mask"].bitwiseOR(w["mask"]).alias("mask"), F.concat(s["spans"], F.array(F.struct(w["start"].alias("start"), w["stop"].alias("stop")))).alias("spans")))
        return F.concat(sets, more)

    def best(sets: Column) -> Column:
        ranked = F.transform(sets, lambda s: F.struct((-F.bit_count(s["mask"])).alias("shown"), s["size"].alias("size"), s["spans"].alias("spans")))
        return F.array_min(ranked)["spans"]

    chosen = _let(F.aggregate(F.transform(windows(text, terms), cut), F.array(none), extend), best)
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.least(length, F.lit(AFTER)).alias("stop"))))


def snippet(text: Column, spans: Column) -> Column:
    """The pieces of a text at spans, with an ellipsis where it goes on."""
    body = F.coalesce(text, F.lit(""))
    piece = lambda s: F.concat(F.when(s["start"] > 0, "…").otherwise(""), F.substring(body, s["start"] + 1, s["stop"] - s["start"]), F.when(s["stop"] < F.length(body), "…").otherwise(""))
    return F.array_join(F.transform(spans, piece), "\n…\n")
