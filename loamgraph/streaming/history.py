"""Chat histories in unknown JSON shapes as messages: a bounded walk over parsed values, roles and texts in one form, repaired times.

A line is one record, parsed to a VARIANT. From each object the walk goes on to the objects under the keys that hold turns, level by
level, at most DEPTH levels; each level is one explode, written once, and the walk ends where a level is empty. An envelope that already shows its message is not walked further.
Lines of more than MOST_BYTES are left out and counted; so are lines that are no JSON. Values deeper than DEPTH are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.lineage import written

#: Keys that hold turns, blocks that are no conversation, channels that are not told, turns that no one wrote, names of roles. Fixed values.
NESTED = ("messages", "history", "conversation", "turns", "events", "items", "item", "payload", "message", "data")
NO_TEXT = ("thinking", "redacted_thinking", "reasoning", "analysis", "tool_use", "tool_result", "server_tool_use", "image")
UNTOLD = ("analysis", "reasoning", "thinking", "system", "developer")
AUTOMATED = ("<task-notification>", "<local-command-", "<command-name>")
TOOL_TYPES = ("TOOL_RESULT", "FUNCTION_CALL_OUTPUT", "TOOL", "TOOL_RESPONSE")
USER_TYPES = ("USERMESSAGE", "USER_MESSAGE")
ASSISTANT_TYPES = ("AGENTMESSAGE", "AGENT_MESSAGE", "ASSISTANTMESSAGE", "ASSISTANT_MESSAGE")
ROLES = {"human": "user", "user": "user", "assistant": "assistant", "ai": "assistant", "tool": "tool", "function": "tool"}
TEXT_KEYS = ("content", "text", "message", "body", "output")
SESSION_KEYS = ("sessionId", "session_id", "conversation_id")
TIME_KEYS = ("timestamp", "created_at", "createdAt")
ID_KEYS = ("id", "uuid", "message_id")
INJECTED = r"(?s)<system-reminder>.*?</system-reminder>"
#: Bytes of the longest record, levels of the walk, and from which number on a time is in milliseconds.
MOST_BYTES, DEPTH, MILLIS = 8 << 20, 6, 1e11


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use() refers to it."""
    return F.transform(F.array(value), use)[0]


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _kind(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(name), F.lit(False))


def _word(v: Column, *keys: str) -> Column:
    """The first value of the keys that is neither missing, null, empty, false nor an object or array, as text."""
    texts = F.array(*[F.try_variant_get(v, f"$.{k}", "string") for k in keys])
    return F.try_element_at(F.filter(texts, lambda t: t.isNotNull() & ~t.isin("", "false", "0") & ~F.substring(t, 1, 1).isin("{", "[")), F.lit(1))


def content(v: Column, levels: int = 2) -> Column:
    """The text of a record: a string, the texts of its blocks by lines, or that of an object within it; without injected context, trimmed."""
    return F.btrim(F.regexp_replace(F.coalesce(_raw(v, levels), F.lit("")), INJECTED, ""), F.lit(" \t\r\n"))


def _block(b: Column) -> Column:
    told = ~F.coalesce(F.try_variant_get(b, "$.type", "string").isin(*NO_TEXT), F.lit(False)) & _kind(_at(b, "text"), "STRING")
    return F.when(_kind(b, "STRING"), F.try_variant_get(b, "$", "string")).when(told, F.try_variant_get(b, "$.text", "string"))


def _raw(v: Column, levels: int) -> Column:
    def of(x: Column) -> Column:
        blocks = F.array_join(F.filter(F.transform(F.try_variant_get(x, "$", "array<variant>"), _block), lambda t: t.isNotNull()), "\n")
        own = F.when(_kind(_at(x, "text"), "STRING"), F.try_variant_get(x, "$.text", "string"))
        inner = F.coalesce(F.when(own != "", own), F.when(_at(x, "content").isNotNull(), _raw(x, levels - 1))) if levels else own
        return F.when(_kind(x, "ARRAY"), blocks).when(_kind(x, "OBJECT"), inner).when(~F.is_variant_null(x), F.try_variant_get(x, "$", "string"))

    return _let(F.coalesce(*[_at(v, k) for k in TEXT_KEYS]), of)


def role(v: Column, text: Column) -> Column:
    """user, assistant or tool; null for what is no turn of a conversation. text is the record's content."""
    kind = F.upper(F.coalesce(_word(v, "type"), F.lit("")))
    channel = F.lower(F.coalesce(_word(v, "channel", "type"), F.lit("")))
    named = F.coalesce(*[F.coalesce(_word(v, k), F.when(_kind(_at(v, k), "OBJECT"), _word(_at(v, k), "role", "name"))) for k in ("role", "author", "sender", "type")])
    alias = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    automated = reduce(lambda a, b: a | b, [text.startswith(p) for p in AUTOMATED])
    none = channel.isin(*UNTOLD) | _word(v, "isMeta").isNotNull() | automated
    tool = _word(v, "tool_call_id", "toolUseId").isNotNull() | kind.isin(*TOOL_TYPES)
    return F.when(F.coalesce(none, F.lit(False)), None).when(tool, "tool").when(kind.isin(*USER_TYPES), "user").when(kind.isin(*ASSISTANT_TYPES), "assistant").otherwise(F.try_element_at(alias, F.lower(named)))


def seconds(v: Column) -> Column:
    """The record's time in seconds: a number (milliseconds from 1e11 on) or a text with a date; null if it is neither."""

    def of(x: Column) -> Column:
        number = F.when(~_kind(x, "STRING"), F.try_variant_get(x, "$", "double"))
        told = F.unix_micros(F.try_to_timestamp(F.when(_kind(x, "STRING"), F.try_variant_get(x, "$", "string")))) / 1e6
        return F.coalesce(F.when(number > MILLIS, number / 1000).otherwise(number), told)

    return _let(F.coalesce(*[F.when(~F.is_variant_null(_at(v, k)), _at(v, k)) for k in TIME_KEYS]), of)


def _envelope(v: Column) -> Column:
    shown = _at(v, "content").isNull() & _at(v, "text").isNull()
    return F.coalesce(shown & _word(_at(v, "message"), "role").isNotNull() & F.lower(_word(v, "type")).isin("user", "assistant"), F.lit(False))


def _children(v: Column) -> Column:
    """The objects under the keys that hold turns, in the order of the keys."""
    none = F.array().cast("array<variant>")
    of = lambda x: F.when(_kind(x, "ARRAY"), F.try_variant_get(x, "$", "array<variant>")).when(_kind(x, "OBJECT"), F.array(x)).otherwise(none)
    return F.filter(F.concat(*[F.coalesce(of(_at(v, k)), none) for k in NESTED]), lambda x: _kind(x, "OBJECT"))


def line_states(lines: DataFrame) -> DataFrame:
    """state (ok, malformed, oversized) and lines, how many lines (value) there are of it; blank lines are none."""
    state = F.when(F.octet_length("value") > MOST_BYTES, "oversized").when(F.try_parse_json("value").isNull(), "malformed").otherwise("ok")
    return lines.where(F.trim("value") != "").select(state.alias("state")).groupBy("state").agg(F.count("*").alias("lines"))


def history_messages(lines: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Messages of lines (source, line, value): source, line, place, session, source_id, role, content, occurred_at (seconds, or null).

    place counts the records that the walk visits in a line, from 0. A record's session is its own, its line's, the first one told in
    the source up to that line, or the source's name. A top-level array gives its objects without a walk.
    """
    big = F.octet_length("value") > MOST_BYTES
    parsed = lines.where(~big & F.trim("value").rlike(r"^[{\[]")).select("source", "line", F.try_parse_json("value").alias("v")).where("v is not null")
    own = _word(F.col("v"), *SESSION_KEYS)
    root = parsed.select("source", "line", "v", own.alias("line_session"), F.when(_kind(F.col("v"), "OBJECT"), seconds(F.col("v"))).alias("line_time"))
    one = root.where(_kind(F.col("v"), "OBJECT")).select("source", "line", "line_session", "line_time", F.array().cast("array<int>").alias("path"), "v", F.lit(True).alias("walk"))
    listed = root.where(_kind(F.col("v"), "ARRAY")).select("source", "line", "line_session", "line_time", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("p", "v"))
    level = written(one.unionByName(listed.where(_kind(F.col("v"), "OBJECT")).select("source", "line", "line_session", "line_time", F.array("p").alias("path"), "v", F.lit(False).alias("walk"))), "records")
    found = level
    for _ in range(depth):
        below = level.where(F.col("walk") & ~_envelope(F.col("v"))).select("source", "line", "line_session", "line_time", "path", F.posexplode(_children(F.col("v"))).alias("p", "v"))
        level = written(below.select("source", "line", "line_session", "line_time", F.concat("path", F.array("p")).alias("path"), "v", F.lit(True).alias("walk")), "records")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    text = content(F.col("v"))
    read = found.select("source", "line", "line_session", "line_time", "path", "v", text.alias("content"))
    told = read.select("source", "line", "line_session", "line_time", "path", "content", role(F.col("v"), F.col("content")).alias("role"), _word(F.col("v"), *SESSION_KEYS).alias("own"), _word(F.col("v"), *ID_KEYS, "step_index").alias("id"), seconds(F.col("v")).alias("time"))
    # a line's records are placed among each other; the group is one line, which MOST_BYTES bounds
    placed = told.groupBy("source", "line").agg(F.array_sort(F.collect_list(F.struct("path", *[c for c in told.columns if c not in ("source", "line", "path")]))).alias("r"))
    placed = placed.select("source", "line", F.posexplode("r").alias("place", "r")).select("source", "line", "place", "r.*").where("role is not null and content <> ''")
    first = root.where("line_session is not null").groupBy("source").agg(F.min(F.struct("line", "line_session")).alias("first"))
    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", "")
    before = F.when(F.col("first.line") <= F.col("line"), F.col("first.line_session"))
    session = F.coalesce("own", "line_session", before, stem)
    out = placed.join(first, "source", "left").withColumn("session", session)
    source_id = F.coalesce("id", F.concat_ws(":", "session", F.col("line").cast("string"), F.col("place").cast("string")))
    return out.select("source", "line", "place", "session", source_id.alias("source_id"), "role", "content", F.coalesce("line_time", "time").alias("occurred_at"))
