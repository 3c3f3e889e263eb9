"""Topics against a plain fold of the rules, in one batch and in five with a restart between."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from loamgraph.functions.lineage import scratch
from loamgraph.streaming import topics as T

TEXTS = [
    ("a", "s1", 1, 1, "user", "Cambia el botón de Jugar y ajusta la textura dorada"), ("a", "s1", 2, 2, "assistant", "Hecho en src/ui/buttons.py y ./README.md, ver https://x.y/z.md"),
    ("a", "s2", 1, 3, "user", "Sobre botón de Jugar: textura dorada más clara"), ("a", "s2", 2, 4, "user", "Ahora el botón 7"), ("a", "s1", 3, 5, "user", "Sigue con el botón 7"),
    ("b", "s9", 1, 6, "user", "Sobre botón de Jugar: textura dorada más clara"), ("b", "s8", 5, 7, "assistant", "no prompt before"), ("b", "s8", 6, 8, "user", "class Parser and function parse in core/parse.py fails with error lines"),
    ("b", "s8", 7, 9, "user", "function parse still fails with error in lines"), ("b", "s7", 1, 10, "user", "function parse alone"), ("b", "s7", 2, 11, "tool", None), ("c", "s6", 1, 12, "user", None),
    ("c", "s6", 2, 13, "user", "web report for the report de ventas 12345"), ("c", "s6", 3, 14, "user", "web only platform shared words alpha beta gamma"), ("c", "s6", 4, 15, "user", "web only platform shared words alpha beta gamma"),
    ("c", "s6", 5, 16, "user", "botones textura and /etc/passwd.txt and /workspace/a/b.ts and ../x.py and B.TS b.ts"), (None, "s", 1, 17, "user", "x"), ("c", None, 1, 18, "user", "x"),
]
SCHEMA = "owner string, session string, seq long, at long, role string, content string"


def plain_features(text):
    text = text or ""
    found = []
    for k, (kind, pattern) in enumerate(T.CONTROLS):
        for m in re.finditer(pattern, text, re.I):
            raw, v = m[1], m[1].lower()
            if v in T.NO_CONTROL or (kind == "screen" and v in T.NO_SCREEN) or (k == 1 and not re.search(r"\b(?:de|del|the)\s+", m[0], re.I) and v not in T.KNOWN_BUTTONS and not raw[:1].isupper()):
                continue
            found.append(f"{kind}:{v}")
    buttons = any(e.startswith("button:") for e in found)
    found += [f"{kind}:{m[1].lower()}" for kind, pattern in T.CONTEXTS for m in re.finditer(pattern, text, re.I) if m[1].lower() not in T.NO_CONTEXT]
    found += ["component_type:button"] * buttons
    found += ["design_group:buttons"] * (buttons or any(re.search(p, text, re.I | re.S) for p in T.DESIGN))
    found = list(dict.fromkeys(found))
    terms = {w for w in re.findall(r"\w{4,}", text.lower()) if w not in T.NO_TERM and not w.isdigit()} - {e.split(":", 1)[1] for e in found}
    terms |= {f"__action_{a}__" for w, a in T.ACTIONS.items() if re.search(rf"\b{w}\b", text, re.I)}
    return found, terms | ({T.CONTINUATION} if re.search(T.CONTINUES, text, re.I) else set())


def plain_topics(rows, files):
    topics, by_session, out = {}, {}, {}
    for turn, (owner, session, seq, _, role, text) in enumerate(sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[3], r[1], r[2]))):
        if role == "user" or (owner, session) not in by_session:
            found, terms = plain_features(text) if role == "user" else ([], set())
            found = found + (files[session, seq] if role == "user" else [])
            same = {e for e in found if e.split(":", 1)[0] not in T.TOO_WIDE}
            near = [(min(3, len(terms & t["terms"])), t["turn"], k) for k, t in topics.items() if t["owner"] == owner and t["entities"] & same and (len(terms & t["terms"]) >= 2 or T.CONTINUATION in terms)]
            topic = max(near)[2] if near else "top_" + T.key_of(session, seq)
            t = topics.setdefault(topic, {"owner": owner, "entities": set(), "terms": set(), "turn": 0})
            t["entities"] |= same
            t["terms"] |= terms
            t["turn"] = turn
            by_session[owner, session] = topic
        out[session, seq] = by_session[owner, session]
    return out


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_features(spark):
    df = T.features(spark.createDataFrame(TEXTS, SCHEMA))
    for r in df.where("role = 'user'").collect():
        text = next(x[5] for x in TEXTS if x[1] == r["session"] and x[2] == r["seq"])
        found, terms = plain_features(text)
        assert [e for e in r["entities"] if not e.startswith("file:")] == found and set(r["terms"]) == terms, text
    files = {(r["session"], r["seq"]): r["files"] for r in df.collect()}
    assert files["s1", 2] == ["file:src/ui/buttons.py", "file:README.md"] and files["s8", 6] == ["file:core/parse.py"]
    assert files["s6", 5] == ["file:a/b.ts", "file:B.TS"]


def test_one_batch_equals_a_restarted_stream(rocks):
    more = [(f"o{i % 3}", f"t{i % 11}", i, 100 + i, "user" if i % 3 else "assistant", f"function f{i % 5} word{i % 4} thing{i % 7} other{i % 2}" + " sigue" * (i % 9 == 0)) for i in range(120)]
    rows = TEXTS + more
    df = rocks.createDataFrame(rows, SCHEMA)
    files = {(r["session"], r["seq"]): r["files"] for r in T.features(df).collect()}
    want = plain_topics(rows, files)
    got = T.assign_topics(df).collect()
    assert {(r["session"], r["seq"]): r["topic"] for r in got} == want and len(got) == len(want)
    assert {r["action"] for r in got} == {"created", "continued", "attached"}
    base = scratch(rocks, "topics-test")
    ordered = sorted(rows, key=lambda r: (r[3], r[1] or "", r[2]))
    for k in range(5):  # five batches, each its own run of the stream; the last one comes twice
        rocks.createDataFrame(ordered[k * len(rows) // 5 : (k + 1) * len(rows) // 5], SCHEMA).write.mode("append").parquet(f"{base}/in")
        if k == 4:
            rocks.createDataFrame(ordered[-10:], SCHEMA).write.mode("append").parquet(f"{base}/in")
        T.run_topics(rocks, f"{base}/in", SCHEMA, f"{base}/out", f"{base}/state")
    told = rocks.read.parquet(f"{base}/out")
    assert {(r["session"], r["seq"]): (r["topic"], r["episode"], r["action"]) for r in told.collect()} == {(r["session"], r["seq"]): (r["topic"], r["episode"], r["action"]) for r in got}
    assert told.count() == len(want)


def test_no_rows(rocks):
    assert T.assign_topics(rocks.createDataFrame([], SCHEMA).withColumn("topic", F.lit("x"))).count() == 0


class Store(dict):
    """A map state of plain values that counts its reads."""

    reads = 0

    def getValue(self, key):
        self.reads += 1
        return self.get(key[0])

    def updateValue(self, key, value):
        self[key[0]] = value


def test_a_match_looks_at_the_latest_topics_and_a_new_owner_reads_nothing():
    stores = Store(), Store()
    by_entity, topics = T._Held(stores[0], True, gave=lambda v: (list(v[0]),)), T._Held(stores[1], True, lambda v: (v[0], set(v[1])), lambda v: (v[0], sorted(v[1])))
    near, looked = T._Near(by_entity, topics), []
    for turn in range(1, 2001):
        topics.put(f"t{turn}", (turn, {"aaaa", "bbbb", "cccc", f"w{turn}"} - ({"cccc"} if turn > 1990 else set())))
        near.touch(f"t{turn}", ["e:x"] if turn % 2 else ["e:x", "e:y"])
    topics.put("t7", (2001, {"aaaa"}))
    near.touch("t7", [])
    get, topics.get = topics.get, lambda key: looked.append(key) or get(key)
    assert T._match(["e:x"], {"aaaa", "bbbb", "cccc"}, near) == "t1990" and len(looked) < 60 and not stores[0].reads + stores[1].reads
    assert T._match(["e:y", "e:x"], {"bbbb", "aaaa"}, near) == "t2000" and T._match(["e:z"], {"aaaa", "bbbb"}, near) is None
    assert T._match(["e:x"], {"none", T.CONTINUATION}, near) == "t7" and T._match(["e:x"], {"none", "aaaa"}, near) is None
    for held in (by_entity, topics):
        held.write()
    again = T._Near(T._Held(stores[0], False), T._Held(stores[1], False, lambda v: (v[0], set(v[1]))))
    assert T._match(["e:x"], {"aaaa", "bbbb", "cccc"}, again) == "t1990" and list(stores[0]["e:x"][0])[-1] == "t7"
