"""Topics of conversations: a state machine over a stream of messages, by owner.

A user message opens an episode. It goes on with a live topic of its owner that shares an entity with it and at least two work
terms (or any number of them where the message says that it continues); else it opens a topic. Other messages belong to
their session's last episode. Entities and terms come from column expressions; the state machine only folds.

State is held by owner, in three maps: entity to topics, topic to its terms and last turn, session to its two cursors and its
episode. A batch reads and writes only the entries that its messages touch. The first cursor is the last message that has a
topic; the second one, of file references, follows it and can be set back alone without touching topics. A seq at or below
a session's cursor is a repeat and changes nothing. Messages are folded in the order (at, session, seq), so results do not depend
on where batches end as long as batches come in that order.

File references of replies are told with their message and are no identity of a topic: otherwise the topics would depend on
the batches. A message without text opens or continues like any other, without entities. Messages without owner, session or
seq are left out.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import OrderedDict, defaultdict
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of entities and what tells them; the first group is the key. Fixed values.
CONTROLS = (
    ("button", r"\b(?:bot[oó]n|button|btn)\s*#?\s*([0-9]+)\b"),
    ("button", r"\b(?:bot[oó]n(?:es)?|button|btn)\s+(?:de\s+|del\s+|the\s+)?([a-záéíóúñ][\wáéíóúñ.-]{1,30})\b"),
    ("screen", r"\b(?:pantalla|screen|vista|view)\s+[\"']?([\w.-]+)"),
)
CONTEXTS = (
    ("feature", r"\b(?:funcionalidad|feature|caracter[ií]stica)\s+(?:de|del|para)\s+(?:(?:el|la|los|las)\s+)?(?:(?:bot[oó]n(?:es)?)\s+(?:de|del)\s+)?([a-záéíóúñ][\wáéíóúñ.-]{1,30})\b"),
    ("module", r"\b(?:m[oó]dulo|secci[oó]n|area|área)\s+(?:de|del|para)\s+(?:(?:el|la|los|las)\s+)?([a-záéíóúñ][\wáéíóúñ.-]{1,30})\b"),
    ("report", r"\b(reporte|report|informe)\b"),
    ("report", r"\b(?:reporte|report|informe)\s+(?:de|del|para)\s+([a-záéíóúñ][\wáéíóúñ.-]{1,30})\b"),
    ("platform", r"\b(android|ios|apk|unity|web|m[oó]vil)\b"),
    ("python_function", r"\b(?:funci[oó]n|function|def)\s+(?:de\s+)?([A-Za-z_]\w*)"),
    ("python_class", r"\b(?:clase|class)\s+(?:de\s+)?([A-Za-z_]\w*)"),
    ("python_method", r"\b(?:m[eé]todo|method)\s+(?:de\s+)?([A-Za-z_]\w*)"),
)
#: Words that are no keys, and labels of buttons that are known without capital or preposition. Fixed values.
NO_CONTROL = ("de", "del", "the", "el", "la", "los", "las", "button", "boton", "botón", "color", "tamaño", "tamano", "diseño", "diseno", "estilo")
NO_SCREEN = ("debe", "para", "sale", "se", "tan", "todavía", "todavia")
NO_CONTEXT = ("de", "del", "para", "el", "la", "los", "las", "botón", "boton", "button", "color", "tamaño", "tamano", "diseño", "diseno", "estilo")
KNOWN_BUTTONS = ("jugar", "fichas", "ajustes", "volver")
#: What makes a message one about the design of buttons. Fixed value.
DESIGN = (
    r"\b(?:diseñ[oa]|estilo|apariencia|color(?:es)?|tema)\b.{0,35}\bbot[oó]n(?:es)?\b",
    r"\bbot[oó]n(?:es)?\b.{0,35}\b(?:diseñ[oa]|estilo|apariencia|color(?:es)?|tema)\b",
)
#: Words that are no work terms, words that name an action, and words that go on with something. Fixed values.
NO_TERM = (
    "cambia", "cambiar", "change", "el", "la", "los", "las", "un", "una", "por", "para", "del", "de", "que", "ahora", "también", "tambien", "debe", "deben", "quiero", "botón", "botones", "boton",
    "button", "btn", "pantalla", "screen",
)
ACTIONS = {
    "cambia": "change", "cambiar": "change", "cambié": "change", "change": "change", "ajusta": "adjust", "ajustar": "adjust", "mejora": "improve", "mejorar": "improve", "corrige": "correct",
    "corregir": "correct", "revisa": "review", "revisar": "review", "verifica": "verify", "verificar": "verify", "prueba": "test", "probar": "test", "usa": "set", "usar": "set",
}
CONTINUES = r"\b(?:ahora|también|tambien|sigue|continuar|retoma|retomar)\b"
#: Entities by which topics are never matched. Fixed value.
TOO_WIDE = ("component_type", "design_group", "platform")
#: Suffixes of files that a message can mention. Fixed value.
SUFFIXES = (
    "pyi?|js|jsx|ts|tsx|mjs|cjs|html|css|scss|jsonc?|ya?ml|toml|md|sql|sh|bash|cs|java|go|rs|php|rb|kt|swift|c|h|cpp|hpp|vue|svelte|xml|env|ini|cfg|txt|prefab|unity|asset|asmdef|shader|compute|"
    "mat|uxml|uss|meta|csproj|sln|gradle|dart|ipynb|properties"
)
MOST_FILES = 50
CONTINUATION = "__continuation__"

ASSIGNED = "owner string, session string, seq long, at long, role string, topic string, episode string, action string, entities array<string>, files array<string>"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?iUs)" + pattern), F.lit(group))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?iUs)" + pattern)


def _keyed(kind: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(kind + ":"), F.lower(k)))


def _without(keys: Column, words: tuple[str, ...]) -> Column:
    return F.filter(keys, lambda v: ~F.lower(v).isin(*words))


def entities(text: Column) -> Column:
    """The entities that a text names, as kind:key, each once in the order of the kinds' patterns."""
    parts = []
    for k, (kind, pattern) in enumerate(CONTROLS):
        if k == 1:  # a name counts after a preposition, with a capital, or if it is a known label
            both = F.arrays_zip(_found(text, pattern, 0).alias("a"), _found(text, pattern).alias("b"))
            named = lambda x: _has(x["a"], r"\b(?:de|del|the)\s+") | F.lower(x["b"]).isin(*KNOWN_BUTTONS) | F.substring(x["b"], 1, 1).rlike(r"(?U)\p{Lu}")
            keys = F.transform(F.filter(both, named), lambda x: x["b"])
        else:
            keys = _found(text, pattern)
        parts.append(_keyed(kind, _without(keys, NO_CONTROL + (NO_SCREEN if kind == "screen" else ()))))
    buttons = F.size(parts[0]) + F.size(parts[1]) > 0
    for kind, pattern in CONTEXTS:
        parts.append(_keyed(kind, _without(_found(text, pattern), NO_CONTEXT)))
    none = F.array().cast("array<string>")
    parts.append(F.when(buttons, F.array(F.lit("component_type:button"))).otherwise(none))
    parts.append(F.when(buttons | _has(text, DESIGN[0]) | _has(text, DESIGN[1]), F.array(F.lit("design_group:buttons"))).otherwise(none))
    return F.array_distinct(F.concat(*parts))


def work_terms(text: Column, keys: Column) -> Column:
    """Words of four letters and more that are no entity's key, the actions that a text names, and whether it continues something."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w]{4,})"), F.lit(1)), lambda w: ~w.isin(*NO_TERM) & ~w.rlike(r"(?U)^\d+$"))
    out = [F.array_except(words, F.transform(keys, lambda e: F.regexp_replace(e, "^[a-z_]+:", "")))]
    out += [F.when(_has(text, rf"\b{word}\b"), F.array(F.lit(f"__action_{action}__"))).otherwise(F.array().cast("array<string>")) for word, action in ACTIONS.items()]
    out.append(F.when(_has(text, CONTINUES), F.array(F.lit(CONTINUATION))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*out))


def file_references(text: Column, root: str = "/workspace", most: int = MOST_FILES) -> Column:
    """Files that a text mentions, as file:key: paths relative to root, or bare names. Addresses and paths that leave root are none."""
    bare = F.regexp_replace(text, r"(?i)https?://\S+", " ")
    pattern = rf"(?<![\w./-])(/(?:[A-Za-z0-9_@+.-]+/)*[A-Za-z0-9_@+.-]+\.(?:{SUFFIXES})|(?:[A-Za-z0-9_@+.-]+/)*[A-Za-z0-9_@+.-]+\.(?:{SUFFIXES})(?=$|[#:\s`'\"<>()\[\]{{}},;!?]))"
    found = F.regexp_extract_all(bare, F.lit("(?i)" + pattern), F.lit(1))
    prefix = root.rstrip("/") + "/"
    inside = F.filter(found, lambda p: ~F.concat(F.lit("/"), p, F.lit("/")).contains("/../") & (~p.startswith("/") | p.startswith(prefix)) & (F.length(p) <= 512))
    keys = F.transform(inside, lambda p: F.regexp_replace(F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 20)).otherwise(p), r"^\./", ""))
    # each once in any case, as first spelled
    once = F.filter(keys, lambda k, i: F.array_position(F.transform(keys, lambda o: F.lower(o)), F.lower(k)) == i + 1)
    return F.transform(F.slice(once, 1, most), lambda k: F.concat(F.lit("file:"), k))


def features(messages: DataFrame, root: str = "/workspace") -> DataFrame:
    """Messages (owner, session, seq, at, role, content) with their entities, terms and files; a user's files are entities too."""
    text = F.coalesce("content", F.lit(""))
    told = messages.where("owner is not null and session is not null and seq is not null").select(
        F.col("owner").cast("string").alias("owner"), F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"),
        F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), entities(text).alias("own"), file_references(text, root).alias("files"),
    )
    user = F.col("role") == "user"
    none = F.array().cast("array<string>")
    return told.select("owner", "session", "seq", "at", "role", "files", F.when(user, F.concat("own", "files")).otherwise(none).alias("entities"), F.when(user, work_terms(F.col("text"), F.col("own"))).otherwise(none).alias("terms"))


def key_of(session: str, seq: int) -> str:
    """What the ids of a message's topic and episode end with."""
    return hashlib.sha256(f"{session}:{seq}".encode("utf-8", "surrogatepass")).hexdigest()[:24]


class _Held:
    """Entries of one map state that a batch touches, read once and written back at its end; a new owner has none to read.

    An entry is held as took() makes it of a state's value; gave() makes the value again.
    """

    def __init__(self, state: Any, new: bool, took: Callable[[tuple], tuple] = tuple, gave: Callable[[tuple], tuple] = tuple) -> None:
        self.state, self.new, self.took, self.gave, self.now, self.changed = state, new, took, gave, {}, set()

    def get(self, key: str) -> tuple | None:
        if key not in self.now:
            value = None if self.new else self.state.getValue((key,))
            self.now[key] = None if value is None else self.took(value)
        return self.now[key]

    def put(self, key: str, value: tuple) -> None:
        self.now[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            self.state.updateValue((key,), self.gave(self.now[key]))


class _Near:
    """An owner's topics by entity in the order of their last turns; an entity's topics are read once a batch."""

    def __init__(self, by_entity: _Held, topics: _Held) -> None:
        self.by_entity, self.topics, self.of, self.entities = by_entity, topics, {}, defaultdict(set)

    def at(self, entity: str) -> OrderedDict:
        if entity not in self.of:
            held = (self.by_entity.get(entity) or ((),))[0]
            self.of[entity] = OrderedDict.fromkeys(sorted(held, key=lambda t: self.topics.get(t)[0]))
            for topic in held:
                self.entities[topic].add(entity)
        return self.of[entity]

    def touch(self, topic: str, found: list[str]) -> None:
        """The topic, whose turn is now, has these entities besides those that it had."""
        for e in found:
            at = self.at(e)
            if topic not in at:
                at[topic] = None
                self.entities[topic].add(e)
                self.by_entity.put(e, (at,))
        for e in self.entities[topic]:
            self.of[e].move_to_end(topic)

    def latest(self, found: list[str]) -> Iterator[str]:
        """The topics of these entities, latest first; one of several entities comes several times."""
        return heapq.merge(*(reversed(self.at(e)) for e in found), key=lambda t: -self.topics.get(t)[0])


class Topics(StatefulProcessor):
    """The state machine of one owner; see the module's text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.by_entity = handle.getMapState("by_entity", "entity string", "topics array<string>")
        self.topics = handle.getMapState("topics", "topic string", "turn long, terms array<string>")
        self.sessions = handle.getMapState("sessions", "session string", "cursor long, file_cursor long, topic string, episode string")
        self.turns = handle.getValueState("turns", "turn long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "session", "seq"], kind="stable")
        held = self.turns.get() if self.turns.exists() else None
        turn, new = held[0] if held else 0, held is None
        by_entity, sessions = _Held(self.by_entity, new, gave=lambda v: (list(v[0]),)), _Held(self.sessions, new)
        topics = _Held(self.topics, new, lambda v: (v[0], set(v[1])), lambda v: (v[0], sorted(v[1])))
        near = _Near(by_entity, topics)
        out = []
        for m in batch.itertuples(index=False):
            cursor, file_cursor, topic, episode = sessions.get(m.session) or (-1, -1, None, None)
            if m.seq <= cursor:
                continue
            turn += 1
            action = "attached"
            if m.role == "user" or episode is None:
                name = key_of(m.session, m.seq)
                match = _match(m.entities, set(m.terms), near) if m.role == "user" else None
                topic, episode, action = match or "top_" + name, "epi_" + name, "continued" if match else "created"
                before = topics.get(topic) if match else None
                topics.put(topic, (turn, (before[1] if before else set()).union(m.terms)))
                near.touch(topic, [e for e in m.entities if e.split(":", 1)[0] not in TOO_WIDE])
            files = list(m.files) if m.seq > file_cursor else []
            sessions.put(m.session, (int(m.seq), max(int(m.seq), file_cursor), topic, episode))
            out.append((m.owner, m.session, m.seq, m.at, m.role, topic, episode, action, list(m.entities), files))
        for held in (by_entity, topics, sessions):
            held.write()
        self.turns.update((turn,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ASSIGNED.split(", ")])

    def close(self) -> None:
        pass


def _match(found: list[str], terms: set[str], near: _Near) -> str | None:
    """The topic that a message continues: of those that share an entity and enough terms the one with most (up to three), then the latest.

    No two topics have one last turn. Latest first, the first one with three terms is it, so common words do not cost a look at all topics.
    """
    best, most = None, -1 if CONTINUATION in terms else 1
    for t in near.latest(found):
        n = min(3, len(terms & near.topics.get(t)[1]))
        if n > most:
            best, most = t, n
            if n == 3:
                break
    return best


def assign_topics(messages: DataFrame, root: str = "/workspace") -> DataFrame:
    """A row for each new message (owner, session, seq, at, role, content), a batch or a stream, with its topic, episode, action, entities and files.

    A stream needs the RocksDB state store. Owners are spread over tasks; one owner's messages are a fold in their order.
    """
    _ = messages.sparkSession.streams.active  # a batch, too, needs the coordinator of state stores, which starts with the stream manager
    return features(messages, root).groupBy("owner").transformWithStateInPandas(statefulProcessor=Topics(), outputStructType=ASSIGNED, outputMode="Append", timeMode="None")


def run_topics(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str) -> None:
    """Take in all new files of messages (Parquet) in folder once and stop; rows go to the table, the checkpoint holds cursors and topics."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)  # a stream keeps the setting it starts with
    try:
        stream = assign_topics(spark.readStream.schema(schema).parquet(folder))
        stream.writeStream.option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before:
            spark.conf.set(key, before)
        else:
            spark.conf.unset(key)
