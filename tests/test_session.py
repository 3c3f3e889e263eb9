"""Session, routing and evidence operators on small literal input; plans and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.operators import session as O
from loamgraph.plans import intent as I
from loamgraph.streaming import tail


def messages(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "session long, seq long, content string")


def test_route_keeps_until_cleared(spark):
    m = messages(spark, ["hello", "in alpha we", "go on", "alpha or beta?", "well", "beta then"])
    assert [r["project"] for r in O.route(m, ["alpha", "beta"]).orderBy("seq").collect()] == [None, "alpha", "alpha", None, None, "beta"]
    assert O.route_status(O.route(m, ["alpha", "beta"])).first()["status"] == "ambiguous"
    assert O.route_status(O.route(messages(spark, ["x"]), ["alpha"])).first()["status"] == "unassigned"


def test_dispatch_fans_out_up_to_the_cap(spark):
    calls = spark.createDataFrame([(1, "few"), (2, "many"), (3, "none")], "call_id long, contract string")
    rows = [("few", f"f{i}") for i in range(8)] + [("many", f"m{i}") for i in range(9)]
    got = O.dispatch(calls, spark.createDataFrame(rows, "contract string, id string")).collect()
    assert sum(r["call_id"] == 1 for r in got) == 8 and [r["target"] for r in got if r["call_id"] == 2] == ["9 overrides"] and all(r["call_id"] != 3 for r in got)


def test_spaced_terms(spark):
    words = [f"w{i:02}" for i in range(60)]
    got = spark.createDataFrame([(" ".join(words),), ("only three words",), (None,)], "t string").select(O.spaced_terms(F.col("t"))).collect()
    assert got[0][0][:8] == words[:8] and got[0][0][-8:] == words[-8:] and len(got[0][0]) == 24 and got[0][0] == sorted(got[0][0])
    assert got[1][0] == ["only", "three", "words"] and got[2][0] == []


def test_grade_and_obligations(spark):
    a = spark.createDataFrame([(1, "Run `x` on PORT 8080 because yes"), (2, "no"), (3, None)], "answer_id int, text string")
    rows = O.grade(a, {"p": ["port", "80"], "q": ["because", "zzz"]}, {"f": ["yes", "^run"], "g": ["no$"]}).collect()
    got = {r["answer_id"]: (r["covered"], r["partial"], r["score"], r["factual_errors"], r["adjusted_score"]) for r in rows}
    assert got == {1: (1, 1, 0.75, 1, 0.25), 2: (0, 0, 0.0, 1, 0.0), 3: (0, 0, 0.0, 0, 0.0)}
    df = spark.createDataFrame([("¿Qué comando y qué PUERTO usó, y por qué?", "`git push` a :8080"), ("portable hostess", "x"), ("backend and url?", "see http://localhost:80"), ("modo?", None)], "q string, a string")
    assert [r[0] for r in df.select(O.obligations(F.col("q"), F.col("a"))).collect()] == [["rationale"], [], [], ["mode"]]


def test_linearisation(spark):
    rows = [("h", "Base", None, ["Kernel"], []), ("h", "Sub", "Base", ["A", "B"], ["P"]), ("h", "Loop", "Loop", [], [])]
    df = spark.createDataFrame(rows, "root string, type string, parent string, includes array<string>, prepends array<string>")
    got = {}
    for r in O.linearise(df).orderBy("type", "position").collect():
        got.setdefault(r["type"], []).append(r["ancestor"])
    assert got == {"Base": ["Base", "Kernel"], "Sub": ["P", "Sub", "B", "A", "Base", "Kernel"], "Loop": ["Loop"]}


def test_bootstrap_is_repeatable(spark):
    d = spark.createDataFrame([(float(x),) for x in range(1, 30)], "delta double")
    a, b = (tuple(O.bootstrap(d, "delta", 200).first()) for _ in range(2))
    assert a == b and a[0] == 29 and a[2] < 15.0 < a[3] and a[4] < 0.05
    assert O.bootstrap(d.limit(0), "delta", 200).count() == 0


def test_bootstrap_is_exact_for_few_pairs_and_takes_many(spark):
    p = lambda *v: O.bootstrap(spark.createDataFrame([(float(x),) for x in v], "delta double"), "delta").first()["p"]
    assert p(1, 2, 3) == 2 / 8 and p(1, -1) == 1.0 and p(*[0.1] * 20) == 2 / 2**20
    many = O.bootstrap(spark.range(100_001).selectExpr("cast(id as double) as delta"), "delta", draws=2, flips=2).first()
    assert many["pairs"] == 100_001 and many["mean"] == 50_000.0


def test_bootstrap_query_takes_the_reference_numbers(spark):
    from loamgraph import registry
    from loamgraph.operators.memory import paired
    from loamgraph.sources import model as M
    from tests.conftest import SF

    pairs = paired(M.table(spark, SF, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "1-URGENT", "5-LOW")
    assert registry.queries()["eval_bootstrap"](spark, SF).first() == O.bootstrap(pairs, "delta", draws=5000, flips=10_000).first()


def test_current_version_and_noise(spark):
    log = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "deleted"), ("b", 1, "ok"), ("b", 3, "fixed")], "key string, at int, status string")
    assert [(r["key"], r["status"]) for r in O.current_version(log, "key", "at").collect()] == [("b", "fixed")]
    nodes = spark.createDataFrame([("1", "if"), ("2", "run")], "id string, name string")
    edges = spark.createDataFrame([("1", "2"), ("2", "2")], "source string, target string")
    kept, e = O.drop_keyword_noise(nodes, edges, ["if"])
    assert kept.count() == 1 and [(r["source"], r["target"]) for r in e.collect()] == [("2", "2")]


def test_intents_and_claims(spark):
    df = spark.createDataFrame([("what is the impact of this change",), ("trace the call chain flow",), ("hello",), (None,)], "t string")
    assert [r[0] for r in df.select(I.classify_intent(F.col("t"))).collect()] == ["impact", "flow", "overview", "overview"]
    a = spark.createDataFrame([(1, "Apples ripen slowly. Zebras gallop quickly. It is so.")], "answer_id int, text string")
    known = spark.createDataFrame([("apples",), ("ripen",), ("slowly",)], "term string")
    assert [r["verdict"] for r in I.validate_claims(a, known).orderBy("claim").collect()] == ["supported", "unsupported", "abstained"]


def test_streaming_cursor_moves_once(spark, tmp_path):
    schema = "session long, seq long, content string"
    src = tmp_path / "in"
    spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], schema).write.parquet(str(src))
    rows: list = []

    def take(batch, _):
        rows.extend(tuple(r) for r in batch.collect())

    def go():
        q = tail.stream_cursor(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    assert sorted(rows)[-2:] == [(1, 1, 2, 1), (2, 0, 1, 1)]
    spark.createDataFrame([(1, 1, "b"), (1, 2, "d")], schema).write.mode("append").parquet(str(src))
    rows.clear()
    go()
    assert max(rows) == (1, 2, 3, 2)
    spark.createDataFrame([(1, k, "x" * 4000) for k in range(3, 103)], schema).write.mode("append").parquet(str(src))
    rows.clear()
    go()
    assert max(rows) == (1, 102, 103, 2 + 9) and tail._batches([5, 5, 90, 5], 10, 30) == [(10, 2), (90, 1), (5, 1)] and tail._batches([1] * 61, 100, 30) == [(30, 30), (30, 30), (1, 1)]
