"""Chat formatting with typed content parts.

A visitor with one method a part type flattens a message's parts (text, image, audio, document) into one
escaped string with ordered placeholders, and records a reference and an expanded token count for each
attachment. A template then marks the turns of a conversation. Everything is a column expression, so the
whole operator stays in the JVM; the only shuffle groups a conversation's turns.

A conversation is one output value by nature, so its turns meet in one row; its size is bounded by the
conversation itself, never by how often its first turn or its texts recur elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A message's content parts. Only the fields that a part's type needs are set.
PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>\n"

#: Control strings of common chat templates. "<|" covers every marker of the form <|name|>.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Double backslashes, then put one backslash after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    """Undo escape(): of two backslashes one stays, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


@dataclass(frozen=True)
class PartVisitor:
    """How each part type is written and how many tokens its attachment expands to."""

    patch: int = 28
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 600
    default_tokens: int = 256

    def visit_text(self, part: Column, n: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0).cast("long")

    def visit_image(self, part: Column, n: Column) -> tuple[Column, Column]:
        tiles = F.ceil(part["width"] / F.lit(self.patch)) * F.ceil(part["height"] / F.lit(self.patch))
        return self._mark("image", n), F.coalesce(tiles, F.lit(self.default_tokens)).cast("long")

    def visit_audio(self, part: Column, n: Column) -> tuple[Column, Column]:
        tokens = F.ceil(part["seconds"] * F.lit(self.audio_tokens_per_second))
        return self._mark("audio", n), F.coalesce(tokens, F.lit(self.default_tokens)).cast("long")

    def visit_document(self, part: Column, n: Column) -> tuple[Column, Column]:
        tokens = part["pages"] * F.lit(self.tokens_per_page)
        return self._mark("document", n), F.coalesce(tokens, F.lit(self.default_tokens)).cast("long")

    @staticmethod
    def _mark(kind: str, n: Column) -> Column:
        return F.concat(F.lit(f"<|{kind}_"), n.cast("string"), F.lit("|>"))

    def flatten(self, parts: Column) -> Column:
        """struct(content, attachments): parts in order; attachments are numbered from 1 within the message.

        A null part or an unknown type counts as text (null text: empty). Null parts: no content.
        """
        visits: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {
            k: getattr(self, f"visit_{k}") for k in ("image", "audio", "document")
        }

        def at(i: Column) -> Column:
            before = F.filter(F.slice(parts, F.lit(1), i), lambda p: p["type"].isin(*visits))
            return F.size(before) + F.lit(1)

        def one(part: Column, i: Column) -> Column:
            text, tokens = self.visit_text(part, i)
            kind = F.lit("text")
            for k, visit in visits.items():
                mine, cost = visit(part, at(i))
                is_k = F.coalesce(part["type"] == F.lit(k), F.lit(False))
                text, tokens, kind = F.when(is_k, mine).otherwise(text), F.when(is_k, cost).otherwise(tokens), F.when(is_k, F.lit(k)).otherwise(kind)
            return F.struct(text.alias("text"), kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))

        seen = F.transform(F.coalesce(parts, F.array().cast(T.ArrayType(PART))), one)
        return F.struct(
            F.array_join(F.transform(seen, lambda p: p["text"]), "").alias("content"),
            F.filter(F.transform(seen, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))), lambda p: p["kind"] != "text").alias("attachments"),
        )


def text_parts(text: Column) -> Column:
    """One text part; null text counts as empty."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    ).cast(T.ArrayType(PART))


def format_chats(messages: DataFrame, visitor: PartVisitor | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format messages (conv_id, turn, role, parts) into one row a conversation.

    Returns conv_id, formatted (string), loss_spans (of each text that carries loss: start from 0 and length in code
    points, and place, the number of its turn, and offset in it), attachments (kind, ref, tokens, turn) and
    expanded_tokens. Turns are ordered by turn, ties by role and content; repeated rows are turns of their own. A null
    role is the empty role. A message without conv_id is a conversation of its own, so no number of them makes one
    large group. Other columns are ignored. An empty table gives no rows. Texts of any length stay whole; memory
    follows the longest conversation, and time its length.
    """
    visitor = visitor or PartVisitor()
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    flat = messages.select("conv_id", lone.alias("lone"), "turn", F.coalesce("role", F.lit("")).alias("role"), visitor.flatten(F.col("parts")).alias("flat"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    turns = flat.select("conv_id", "lone", "turn", "role", F.col("flat.content").alias("content"), head.alias("head"), F.col("flat.attachments").alias("attachments"))
    by = Window.partitionBy("conv_id", "lone").orderBy("turn", "role", "content")
    chars = F.length("head") + F.length("content") + len(END)
    before = F.coalesce(F.sum(chars).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = turns.withColumn("place", F.row_number().over(by)).withColumn("before", before)
    span = F.struct((F.col("before") + F.length("head")).alias("start"), F.length("content").cast("long").alias("length"), F.col("place"), F.length("head").alias("offset"))
    row = F.struct("place", F.concat("head", "content", F.lit(END)).alias("piece"), F.when(F.col("role").isin(*loss_roles), span).alias("span"), "attachments", "turn")
    whole = placed.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list(row)).alias("ts"))  # on the window's partitioning
    attached = F.flatten(F.transform("ts", lambda t: F.transform(t["attachments"], lambda a: F.struct(a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"), t["turn"].alias("turn")))))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("ts", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def _pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, without their ends; no text holds an unescaped end."""
    return F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")


def parse_turns(formatted: Column) -> Column:
    """Read a formatted conversation back: array of struct(role, text)."""
    body = lambda p, k: F.try_element_at(F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|text\|>"), F.lit(k))
    return F.transform(_pieces(formatted), lambda p: F.struct(unescape(body(p, 1)).alias("role"), unescape(body(p, 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between: each span is cut from its own turn, so time follows the length."""
    return F.transform(
        F.array(_pieces(formatted)),  # binds the turns once
        lambda ps: F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.get(ps, s["place"] - 1), s["offset"] + 1, s["length"].cast("int")))), ""),
    )[0]
