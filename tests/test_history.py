"""Chat histories in several shapes."""

from __future__ import annotations

import json

from loamgraph.streaming import history as H

LINES = [
    {"sessionId": "s1", "role": "user", "content": "flat", "timestamp": 1_700_000_000_000, "id": "m1"},
    {"type": "assistant", "uuid": "u2", "timestamp": "2024-01-02T03:04:05Z", "message": {"role": "assistant", "content": [{"type": "text", "text": "one"}, {"type": "thinking", "text": "no"}, "two", {"type": "image"}]}},
    {"conversation_id": "s3", "messages": [{"role": "human", "text": "a", "created_at": 1_700_000_001}, {"role": "ai", "content": {"text": "b"}}, 7, {"role": "system", "content": "no"}, {"history": [{"role": "user", "content": "deep"}]}]},
    {"session_id": "s4", "payload": {"author": {"role": "function"}, "output": "result"}},
    {"items": [{"item": {"type": "USER_MESSAGE", "content": "kept <system-reminder>x\ny</system-reminder> text "}}, {"type": "reasoning", "content": "no"}]},
    {"role": "user", "content": "<command-name>no"},
    {"role": "user", "content": "meta", "isMeta": True},
    {"role": "user", "content": ""},
    {"role": "user", "content": None},
    {"role": "nobody", "content": "no"},
    {"type": "tool_result", "content": "by type"},
    [{"role": "user", "content": "listed"}, {"messages": [{"role": "user", "content": "not walked"}]}, 3],
    {"role": "user", "content": "bad time", "timestamp": "soon"},
]


def test_shapes(spark):
    rows = [("dir/file.jsonl", i, json.dumps(x)) for i, x in enumerate(LINES)] + [("dir/other.jsonl", 0, '{"role": "user", "content": "no session"}'), ("dir/other.jsonl", 1, "not json"), ("dir/other.jsonl", 2, "  "), ("dir/other.jsonl", 3, None)]
    df = spark.createDataFrame(rows, "source string, line long, value string")
    got = [tuple(r) for r in H.history_messages(df).orderBy("source", "line", "place").select("line", "place", "session", "role", "content", "occurred_at").collect()]
    assert got == [
        (0, 0, "s1", "user", "flat", 1_700_000_000.0), (1, 0, "s1", "assistant", "one\ntwo", 1704164645.0), (2, 1, "s3", "user", "a", 1_700_000_001.0), (2, 2, "s3", "assistant", "b", None), (2, 5, "s3", "user", "deep", None),
        (3, 1, "s4", "tool", "result", None), (4, 2, "s1", "user", "kept  text", None), (10, 0, "s1", "tool", "by type", None), (11, 0, "s1", "user", "listed", None), (12, 0, "s1", "user", "bad time", None),
        (0, 0, "other", "user", "no session", None),
    ]
    assert {r["state"]: r["lines"] for r in H.line_states(df).collect()} == {"ok": 14, "malformed": 1}
    assert [r["source_id"] for r in H.history_messages(df).where("line < 2 and source like '%file%'").orderBy("line").collect()] == ["m1", "u2"]
    assert H.history_messages(df.limit(0)).count() == 0


def test_long_records_are_counted_and_left_out(spark):
    df = spark.createDataFrame([("f", 0, json.dumps({"role": "user", "content": "x" * (9 << 20)})), ("f", 1, json.dumps({"role": "user", "content": "y"}))], "source string, line long, value string")
    assert [r["content"] for r in H.history_messages(df).collect()] == ["y"]
    assert {r["state"]: r["lines"] for r in H.line_states(df).collect()} == {"ok": 1, "oversized": 1}
