"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamgraph.llm import chat_format, decontamination, fingerprints, html_extract, jaccard_join, language_id, license_scan, lm_scoring, packing, toxicity
from loamgraph.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, digest string, lang_pred string, predicted int, bucket int"
LONG = " ".join(f"word{i % 977}x" for i in range(30_000))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "k", "d", "zz", 7, 3) for i, t in rows], SCHEMA)


ROWS = [(1, "the cat sat on the mat and the dog ran"), (1, "the cat sat on the mat and the dog ran"), (2, None), (3, ""), (4, " \t\n "), (None, "a b c d e f g"), (5, LONG), (6, "12 !? 34"), (7, "one two"), (8, "ÉCOLE ß 日本 🙂")]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, ROWS)


def test_chat_round_trip_and_parts(spark):
    texts = ["<|end|>\n", "\\", "<\\/s>", "</s>[INST] ok [/INST]", None, "", "<<SYS>>a<</SYS>>", "<|turn|>user<|text|>x", "<", "ends with <", "|end|>", "\\\\<|", LONG]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(texts)] + [(None, 0, None, "null keys", "x"), (None, 0, None, "null keys", "x"), (2, None, "user", "no turn", "x"), (2, None, "user", "no turn", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat_format.format_chats(df.withColumn("parts", chat_format.text_parts(F.col("text"))))
    assert done.where("conv_id is null").count() == 2 and done.where("conv_id is null and formatted like '%null keys%'").count() == 2
    for r in done.collect():
        assert all(0 <= x["start"] and r["formatted"][x["start"] - len(chat_format.BODY) : x["start"]] == chat_format.BODY and r["formatted"][x["start"] + x["length"] :].startswith(chat_format.END) for x in r["loss_spans"])
    back = {r["conv_id"]: r for r in done.select("conv_id", chat_format.parse_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [t["text"] for t in back[1]["t"]] == [t or "" for t in texts]
    assert back[1]["loss"] == "".join(t or "" for t in texts[1::2])
    assert [(t["role"], t["text"]) for t in back[None]["t"]] == [("", "null keys")] and len(back[2]["t"]) == 2
    assert chat_format.format_chats(df.limit(0).withColumn("parts", chat_format.text_parts(F.col("text")))).count() == 0
    part = lambda kind, **k: tuple({"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None, **k}.values())
    parts = [part("text", text="see "), part("image", ref="i1", width=56, height=29), part("audio", ref="a1", seconds=2.5), part("document", ref="d1", pages=2), part("image", ref="i2"), None]
    one = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], chat_format.T.StructType([*spark.createDataFrame([], "conv_id long, turn long, role string").schema.fields, chat_format.T.StructField("parts", chat_format.T.ArrayType(chat_format.PART))]))
    r = chat_format.format_chats(one).first()
    assert "see <|image_1|><|audio_2|><|document_3|><|image_4|><|end|>" in r["formatted"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "i1", 4), ("audio", "a1", 63), ("document", "d1", 1200), ("image", "i2", 256)] and r["expanded_tokens"] == 1523


def test_language_id_edges_and_brute_force(spark, docs):
    names = language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = language_id.fit({"en": ["the cat and the dog that ran with this house"] * 3, "fr": ["le chat et la maison que nous avons dans une rue"] * 3}, names)
    at = {n: i for i, n in enumerate(names)}

    def brute(s: str) -> np.ndarray:
        if not s:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(s) + 1):
            if s[:k] in at:
                out += model.probs[at[s[:k]]] * brute(s[k:])
            elif k == 1:
                out += language_id.UNKNOWN * brute(s[1:])
        return out

    for w in ("▁the", "▁maison", "▁日ab", "▁x"):
        assert np.allclose(language_id.word_scores(language_id.Pieces(names), [w], model.probs)[0], np.log(brute(w)))
    long = "▁" + "maisonthe日" * 150  # far below the least double, and far beyond any piece
    at_end = [np.zeros(2)]
    for j in range(1, len(long) + 1):
        terms = [at_end[i] + np.log(model.probs[at[long[i:j]]]) for i in range(max(0, j - 16), j) if long[i:j] in at]
        if long[j - 1] not in at:
            terms.append(at_end[j - 1] + np.log(language_id.UNKNOWN))
        at_end.append(np.logaddexp.reduce(terms))
    assert np.allclose(language_id.word_scores(language_id.Pieces(names), [long], model.probs)[0], at_end[-1]) and at_end[-1].max() < -1000

    def segmentations(s: str):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            if s[:k] in at or k == 1:
                yield from ([s[:k], *rest] for rest in segmentations(s[k:]))

    want, one = np.zeros(len(names)), model.probs[:, :1]
    for word, n in (("▁maison", 3), ("▁thethe日a", 2)):
        weights = [(math.prod(one[at[p], 0] if p in at else language_id.UNKNOWN for p in s), s) for s in segmentations(word)]
        for x, s in weights:
            for p in s:
                if p in at:
                    want[at[p]] += n * x / sum(x for x, _ in weights)
    assert np.allclose(language_id.expected_counts(language_id.Pieces(names), Counter({"▁maison": 3, "▁thethe日a": 2}), one), want)
    assert np.isclose(language_id.expected_counts(language_id.Pieces(names), Counter({"▁" + "the" * 600: 1}), one) @ [len(n) for n in names], 1801)
    assert language_id.units("न्यायालय का é a2b") == ["▁न्यायालय", "▁का", "▁é", "▁a", "▁b"]
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["lang_pred"] == "en" and by[2]["lang_pred"] == by[3]["lang_pred"] == by[4]["lang_pred"] == by[6]["lang_pred"] == "und" and by[2]["score"] == 0.0
    assert by[8]["lang_pred"] in ("en", "fr") and all(0 <= r["score"] <= 1 for r in got)
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r["lang_pred"] for r in kept.collect()} == {"zz"} and {r["doc_id"] for r in kept.collect()} <= {1, None, 5, 7, 8}
    assert language_id.identify(docs.limit(0), model).count() == 0
    none = language_id.fit_on(docs.where("lang is null"), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def test_language_sample_is_of_distinct_texts(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(language_id, "fit", lambda texts, names: drawn.append(texts))
    for hot in ("the same text again", "one more text that has all these copies"):
        rows = [(hot, "en")] * 3000 + [(f"another text {i}", "en") for i in range(10)] + [(hot, "fr")] * 2000 + [("un texte", "de")]
        language_id.fit_on(spark.createDataFrame(rows, "text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"), most_docs=20)
        assert drawn.pop() == {"de": ["un texte"], "en": sorted([hot, *(f"another text {i}" for i in range(10))]), "fr": [hot]}
    with pytest.raises(ValueError, match="no text drawn for de, en, fr"):
        language_id.fit_on(spark.createDataFrame(rows, "text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"), most_docs=0)


def test_toxicity_edges_and_held_out(spark, docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ka", "to", "mi", "re", "no", "sul", "en"]) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(900):
        ws = [word() for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["vermin", "filthy", "scumbag"]))
        texts.append(" ".join(ws))
        labels.append(int(bad))
    model = toxicity.fit(texts[:700], labels[:700])
    scratch = model.grams.slots()
    right = [(model.margin(t, scratch) > 0) == bool(y) for t, y in zip(texts[700:], labels[700:], strict=True)]
    assert np.mean(right) > 0.95
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r["predicted"] for r in kept.collect()} <= {7}
    flat = toxicity.fit_on(docs, docs.limit(0).select("doc_id", F.lit(1).alias("label")))
    assert {r["predicted"] for r in toxicity.score(docs, flat).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    grams = toxicity.Grams()
    assert len(set(grams.of("abcabcabc abc", scratch).tolist())) == len(grams.of("abcabcabc abc", scratch))


def test_toxicity_against_plain_counts():
    """Features, ratios and scores, counted with dictionaries of n-grams."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Good", "day", "Vermin", "filth", "sun", "tea"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    labels = [int("Vermin" in t or "filth" in t) for t in texts]
    grams = toxicity.Grams(sizes=(3, 4), bits=22)
    scratch = grams.slots()

    def plain(text: str) -> set[str]:
        s = f" {' '.join(text.lower().split())} "
        return {s[i : i + n] for n in (3, 4) for i in range(len(s) - n + 1)}

    every = sorted(set().union(*map(plain, texts)))
    model = toxicity.fit(texts, labels, grams, kept=10**6, l2=0.0, rounds=1)
    pos, neg = (Counter(g for t, y in zip(texts, labels, strict=True) if y == k for g in plain(t)) for k in (1, 0))
    ratio = {g: math.log((pos[g] + 0.5) / (sum(labels) + 1)) - math.log((neg[g] + 0.5) / (len(labels) - sum(labels) + 1)) for g in every}
    norm = math.sqrt(sum(ratio[g] ** 2 for t in texts for g in plain(t) if pos[g] + neg[g] >= 2) / len(texts))
    for t in texts:  # one step of 0.05 from weight 0, times the scaled ratio; n-grams seen in one text have no weight
        want = sorted(0.05 * abs(ratio[g]) / norm if pos[g] + neg[g] >= 2 else 0.0 for g in plain(t))
        assert np.allclose(sorted(np.abs(model.weights[grams.of(t, scratch)])), want, atol=1e-3)
    for t in texts[:20]:
        assert abs(model.margin(t, scratch) - model.bias - sum(float(model.weights[k]) for k in grams.of(t, scratch))) < 1e-5


def test_labelled_sample_is_bounded_and_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "hot text", 5)] * 500 + [(1, f"other text {i}", 5) for i in range(400)] + [(2, None, 5), (3, "x" * 50, 5)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (5, 7), (None, 1)], "doc_id long, label int")
    rows = toxicity.labelled_sample(docs, labels, 100, 20).collect()
    assert 40 < len(rows) < 180 and len(rows) == len(set(rows)) and max(len(r["text"]) for r in rows) <= 20
    assert ("", 0) in {tuple(r) for r in toxicity.labelled_sample(docs, labels).collect()}
    assert {r["predicted"] for r in toxicity.score(docs.where("doc_id = 3"), toxicity.fit_on(docs, labels)).collect()} <= {0, 1}


INTERNAL = "key hash once _key _hash _once leak _leak lang_pred score predicted _lang_pred _score _predicted row_hash class_id digest label label_id head to marked item_id window n component".split()


def test_stages_keep_columns_of_any_name(spark):
    """Every internal name as a column of the input: values come back unchanged."""
    base = spark.createDataFrame(ROWS + [(9, ITEM)], "doc_id long, text string")
    docs = base.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in INTERNAL])
    names = language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    lang = language_id.fit({"en": ["the cat and the dog"], "fr": ["le chat et la maison"]}, names)
    tox = toxicity.fit(["vermin filth", "good day"] * 3, [1, 0] * 3)
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    stages = [lambda d: language_id.keep_identified(d, lang), lambda d: toxicity.keep_clean(d, tox), jaccard_join.keep_one, lambda d: decontamination.drop_leaks(d, items)]
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns and 0 < out.count()
        for r in out.collect():
            assert r["doc_id"] is None or all(r[c] == f"{c}:{r['doc_id']}" for c in INTERNAL)
    assert fingerprints.edited_fingerprints(docs).count() == license_scan.scan(docs).count() == lm_scoring.stupid_backoff(docs).count() == docs.count()
    assert jaccard_join.jaccard_components(docs).count() == docs.count() and packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json")).where("piece = 0").count() == docs.count()


def test_license_scan(spark, docs):
    mit = license_scan.KNOWN["MIT"]
    changed = "Copyright (c) 2020 Some One\n" + mit.upper().replace("COPYRIGHT HOLDERS", "copyright  holders").replace(",", " ,")
    rows = [(1, mit), (2, changed), (3, mit + " extra"), (4, "Licenced under the Apache Licence, version 2.0"), (5, None), (6, LONG)]
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(make(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: "Apache-2.0", 5: None, 6: None}
    assert license_scan.scan(docs).count() == len(ROWS) and license_scan.scan(docs.limit(0)).count() == 0
    holder = "Copyright (c) 2020, Some One\nAll rights reserved.\n\n"
    files = [("MIT", f"MIT License\n\n{holder}{mit}"), ("MIT", f"The MIT License (MIT)\n{holder}{mit}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{holder}{license_scan.KNOWN['BSD-3-Clause']}")]
    files += [("BSD-2-Clause", holder + license_scan.KNOWN["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")), ("ISC", f"ISC License\n\n{holder}{license_scan.KNOWN['ISC']}")]
    files += [(k, t.replace("\n", "\r\n")) for k, t in license_scan.known_texts() if k in ("Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0")]
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(make(spark, [(i, t) for i, (_, t) in enumerate(files)])).collect()}
    assert got == {i: k for i, (k, _) in enumerate(files)}
    twins = spark.createDataFrame([("licence licence, sub licence sub-licence copyright holder copyright holder",)], "t string").select(license_scan.canonical(F.col("t"))).first()[0]
    assert twins == "license license sublicense sublicense copyright owner copyright owner"
    many = [(str(i), f"text number {i}") for i in range(license_scan.MOST_BROADCAST + 1)]
    assert license_scan.scan(make(spark, [(1, "Text NUMBER 7!"), (2, "x")]), many).where("license_id = '7'").count() == 1


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows) -> dict:
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return {i: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for g in groups.values() for i in g}


def test_jaccard_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    rows, common = [], [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 90))] + (common if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(ROWS)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(make(spark, rows), block=2000).collect()}
    want = brute_components(rows)
    assert got == {d: (len(shingles(t)), want[i]) for i, (d, t) in enumerate(rows)}


def test_jaccard_edges(spark, docs):
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] in (1, 2, 3, 4)) == [(1, 1), (1, 1), (2, 2), (3, 3), (4, 4)]
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, None, 5, 6, 7, 8])
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0 and jaccard_join.keep_one(docs.limit(0)).count() == 0
    assert jaccard_join.jaccard_components(docs.where("text is null")).count() == 1


def test_components(spark):
    rows = [("a", "b"), ("b", "c"), ("d", "d"), ("e", "f"), (None, "a"), ("c", "a"), *[(f"x{i:03}", f"x{i + 1:03}") for i in range(40)]]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert {got[k] for k in "abc"} == {"a"} and got["f"] == "e" and "d" not in got and {got[f"x{i:03}"] for i in range(41)} == {"x000"}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


ITEM = "A train leaves Boston at 40 miles per hour and after 3 hours meets Alice who has walked 12 km toward the same station before noon today"


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, ITEM, 9), (2, None, 9), (3, "tiny item here", 9), (4, "", 9), (1, ITEM, 9)], "item_id long, text string, doc_id int")
    same = f"before text here, {ITEM}. and some more after it"
    other = ITEM.replace("40", "75").replace("12 km", "9 miles").replace("Alice", "Carol").replace("Boston", "Dallas")
    mixed = ITEM.replace("40 miles per hour and after 3 hours", "40 miles per hour and after 5 hours")
    rows = [(10, same), (11, other), (12, "quite another text about cats and dogs that share nothing with it at all"), (13, mixed), (14, "tiny item here"), (15, LONG), (None, ITEM), (16, None)]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(make(spark, rows), items).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 1), (14, 3), (None, 1)}
    assert not got[10, 1]["reparameterised"] and got[11, 1]["reparameterised"] and got[11, 1]["coverage"] == 1.0
    kept = decontamination.drop_leaks(make(spark, rows), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [12, 15, 16] and kept.columns == docs.columns
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0 and decontamination.find_leaks(docs.limit(0), items).count() == 0
    assert decontamination.drop_leaks(docs, items.limit(0)).count() == len(ROWS)


def test_inconsistent_slots_are_no_leak(spark):
    item = "if 5 apples cost 5 coins then how many coins do 5 pears and 5 plums cost in total at the market now"
    odd = item.replace("5 apples", "6 apples").replace("5 coins", "7 coins").replace("5 pears", "8 pears")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"] for r in decontamination.find_leaks(make(spark, [(1, odd), (2, item.replace("5", "31"))]), items).collect()}
    assert got == {2}


def test_short_and_number_heavy_items_are_found_inside_documents(spark):
    short, sums, table = "What is the capital of France", "12 + 5 = 17 , 8 + 9 = 17 , 20 + 31 = 51 , 4 + 4 = 8", "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy Mallory Niaj"
    items = spark.createDataFrame([(1, short), (2, sums), (3, "7 + 8 = 15"), (4, f"names {table}"), (5, ITEM), (6, "How many legs have 3 cats")], "item_id long, text string")
    before, after = "a text of many other words stands here before it, and then: ", " and the text goes on for a while behind it as well"
    rows = [(10 * k, before + t + after) for k, t in enumerate((short, sums, "7 + 8 = 15", f"names {table}", ITEM, "How many legs have 3 cats"), 1)]
    rows += [(61, before + "how many legs have 5 cats" + after), (21, before + sums.replace("7", "6") + after), (31, before + "7 + 8 = 16" + after), (99, before + after), (41, short)]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(make(spark, rows), items).collect()}
    assert set(got) == {(10, 1), (41, 1), (20, 2), (30, 3), (40, 4), (50, 5), (60, 6), (61, 6)}
    assert {k for k, r in got.items() if r["reparameterised"]} == {(61, 6)}
    assert all(got[k]["item_windows"] == got[k]["matched_windows"] == 1 for k in ((10, 1), (30, 3), (60, 6), (61, 6))) and got[20, 2]["coverage"] == 1.0
    assert {r["doc_id"] for r in decontamination.drop_leaks(make(spark, rows), items).collect()} == {21, 31, 99}


def test_number_words_are_placeholders(spark):
    item = "Tom has three apples and buys twenty more at the market, so how many apples does he carry home after five hours"
    other = item.replace("three", "seven").replace("twenty", "sixty").replace("five", "nine").replace("Tom", "Ann")
    odd = "Tom has three apples and buys three more at the market, so how many apples does he carry home after three hours"
    items = spark.createDataFrame([(1, item), (2, odd)], "item_id long, text string")
    rows = [(10, f"as it was: {item}. and so on"), (11, f"as it was: {other}. and so on"), (12, "somebody has none of these fruits at all, nor ever had one")]
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.find_leaks(make(spark, rows), items).collect()}
    assert got == {(10, 1): False, (11, 1): True}
    marked = spark.createDataFrame([("It took two hours, then twenty-two days; someone and three2 saw One",)], "t string").select(decontamination.marked_text(F.col("t"))).first()[0]
    assert marked == "it took #two %hours then #twenty #two %days someone and #three #2 saw @one"


def test_stupid_backoff_against_plain_count(spark):
    rows = [(1, "a b a b c"), (2, "a b d"), (3, None), (4, ""), (None, "A b"), (5, "z"), (1, "a b a b c")]
    uni, bi, n = Counter(), Counter(), 0
    toks = [((t or "").lower().split()) for _, t in rows]
    for ts in toks:
        if ts:
            uni["<s>"] += 1
        for h, w in zip(["<s>", *ts], ts, strict=False):
            uni[w] += 1
            bi[h, w] += 1
            n += 1
    want = Counter()
    for (d, _), ts in zip(rows, toks, strict=True):
        s = sum(math.log(bi[h, w] / uni[h]) if bi[h, w] >= 2 else math.log(0.4 * uni[w] / n) for h, w in zip(["<s>", *ts], ts, strict=False))
        want[d, len(ts), round(s, 4)] += 1
    got = lm_scoring.stupid_backoff(make(spark, rows), chunk_docs=2)
    assert Counter((r["doc_id"], r["n_tokens"], round(r["log_score"], 4)) for r in got.collect()) == want
    assert got.where("n_tokens = 0 and mean_log_score is null").count() == 2
    assert lm_scoring.stupid_backoff(make(spark, []), chunk_docs=2).count() == 0 and lm_scoring.stupid_backoff(make(spark, [(1, None)])).first()["log_score"] == 0


@pytest.mark.parametrize("words", [5, (1 << 24) + 3])
def test_chunks_of_any_number_of_words(words):
    made = lm_scoring.Chunk([7, None], np.arange(words, dtype=np.uint64), np.array([0, words - 2, 1], dtype=np.uint32), np.array([2, 3], dtype=np.uint32))
    back = lm_scoring.Chunk.unpack(made.pack())
    assert back.ids == [7, None] and len(back.words) == words and back.seq.tolist() == [0, words - 2, 1] and back.ends.tolist() == [2, 3]


def test_shingle_numbers_beyond_24_bits():
    n = (1 << 24) + 5
    big = np.arange(n, dtype=np.uint64) << np.uint64(20)
    rows = list(jaccard_join._pack_chunk(0, 4, [(1, 1), (2, 2)], [big, big[-3:]]))
    seen = [jaccard_join._asked(raw) for bucket, _, raw in rows if bucket >= 0]
    assert sum(len(k) for k, _, _ in seen) == n and max(int(number.max()) for _, number, _ in seen) == n - 1 and sum(int(c.sum()) for _, _, c in seen) == n + 3


def test_packing_round_trip(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.best_fit_pack(docs, path, shard_pieces=4).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for ps in pieces.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at
            at += n
        assert at <= 2048
    want = Counter()
    for d, t in ROWS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            own = ids[s : s + 2048]
            want[d, k, s, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert packing.best_fit_pack(docs.limit(0), path).count() == 0


def test_cached_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["It's I'll we'd THE ÉCOLE straße x+y=z 3.14 ... ###", "İstanbul ΑΣ “quoted” á", "<|endoftext|> x", "a<b", "", "tab\tnew\nline", "o'clock'sx ''s", "日本語", "a\x00b", "×÷ÀÿÞ"]
    texts += ["''s 's's I'LL o'ré 12'd a1b2", "\x0b x", "ends with '", "  two  blanks\r\n\t", "it'sÉ 'RE're", "“", "no odd here"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    enc = packing.CachedEncoder(path, most_tokens=3)
    for some in (slice(None), slice(None), slice(0, 1), slice(4, 5), slice(0, 0), slice(2, 12), slice(-1, None)):
        ids, ends = enc(pa.array(texts[some], pa.string()))
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == want[some] and len(ids) == sum(map(len, want[some]))
    assert list(packing.by_size(pa.array(["ab", None, "cdefgh", "", "i"]), 3)) == [(0, 2), (2, 3), (3, 5)] and not list(packing.by_size(pa.array([], pa.string()), 3))


@pytest.mark.parametrize("seed", range(4))
def test_pack_lengths_is_tight(seed):
    rng = np.random.default_rng(seed)
    n = np.concatenate([rng.integers(1, 2049, 3000), np.full(500, 2048), rng.integers(1, 200, 2000)])
    seq, off = packing.pack_lengths(n, 2048)
    load = np.bincount(seq, weights=n)
    assert load.max() <= 2048 and len(load) <= math.ceil(n.sum() / 2048) * 1.01 + 1
    for s in rng.integers(0, len(load), 50):
        i = np.flatnonzero(seq == s)
        i = i[np.argsort(off[i])]
        assert (off[i] == np.append(0, np.cumsum(n[i])[:-1])).all()
    assert len(packing.pack_lengths(np.zeros(0, dtype=np.int64), 2048)[0]) == 0


def test_fingerprints(spark, docs):
    rows = sorted([r for r in ROWS if r[0] is not None and r != (1, ROWS[0][1])] + [(1, ROWS[0][1])], key=lambda r: r[0])
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(make(spark, rows)).collect()}

    def mark(text):
        w = re.sub(r"[\x20\x09-\x0D]+", " ", text.lower()).split(" ")
        w = [x for x in w if x]
        sh = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        all_ = sorted({hashlib.md5(s.encode()).hexdigest()[:12] for s in sh})
        below = [h for h in all_ if h < "20"]
        return ",".join(below if len(below) >= 16 else all_[:16])

    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        assert (got[d]["n_chars"], got[d]["edited"], got[d]["fingerprint"], got[d]["edited_fingerprint"], got[d]["next_fingerprint"]) == (len(t), e, mark(t), mark(e), mark(nxt))
    assert fingerprints.edited_fingerprints(docs).count() == len(ROWS) and fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
    short = make(spark, [(1, "one two three"), (2, "one two three"), (None, "lost words"), (None, "a b c d e f g"), (3, ""), (4, None), (5, "one two three")])
    got = {(r["doc_id"], r["n_chars"]): r for r in short.transform(fingerprints.edited_fingerprints).withColumn("near", fingerprints.containment(F.col("fingerprint"), F.col("next_fingerprint"))).collect()}
    assert {k: r["near"] for k, r in got.items()} == {(1, 13): 1.0, (2, 13): 0.0, (None, 10): 0.0, (None, 13): 0.0, (3, 0): 1.0, (4, 0): 0.0, (5, 13): 0.0} and all(r["fingerprint"] for k, r in got.items() if k[1])


def test_sketches_merge_and_contain(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (2, 5, 12, 19, 40, 300, 4000)]
    texts += [" ".join(texts[6].split()[:k]) for k in (8, 30, 400, 2000)]
    both = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    sketch = both.select("a", "b", fingerprints.fingerprint(F.col("a")).alias("x"), fingerprints.fingerprint(F.col("b")).alias("y"))
    for r in sketch.select("*", fingerprints.merge(F.col("x"), F.col("y")).alias("m"), fingerprints.containment(F.col("x"), F.col("y")).alias("c")).collect():
        a, b = ({hashlib.md5(" ".join(s).encode()).hexdigest()[:12] for s in (t.split()[i : i + 5] for i in range(max(1, len(t.split()) - 4)))} for t in (r["a"], r["b"]))
        below = sorted(h for h in a | b if h < "20")
        assert r["m"] == ",".join(below if len(below) >= 16 else sorted(a | b)[:16])
        if r["a"] == r["b"]:
            assert r["c"] == 1.0
        elif min(len(a), len(b)) > 300:
            assert abs(r["c"] - len(a & b) / min(len(a), len(b))) < 0.2
        elif not a & b:
            assert r["c"] == 0.0


def test_html_extraction(spark):
    page = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
    <div class="cookie-banner">We use cookies on this site.</div><article><h1>A &amp; B</h1><p>First  para&shy;graph with un<b>bro</b>ken words,\n and more.</p><div class="ad">Buy now.</div><p>Second one follows here.</p></article>
    <section class="comments"><div class="comment"><p>I liked this one a lot.</p></div></section><footer>&copy; 2020</footer></body></html>"""
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>" * 5000, "x"), (5, "u", "<article><p>cut off here in the middle &am", "x"), (None, "u", "<!-- open", "x"), (1, "u", page, "x"), (6, "u", "<article>" + "<p>Some words stand here.</p>" * 3000 + "</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "A & B First para­graph with unbroken words, and more. Second one follows here."
    assert all(r["n_chars"] == len(r["text"]) for r in got) and by[2]["text"] == by[3]["text"] == by[4]["text"] == ""
    assert by[6]["text"].count("Some words stand here.") == 3000 and by[5]["text"] == "cut off here in the middle &am"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_skipped_elements_end_where_they_end():
    def texts(page):
        return [b.text for b in html_extract.blocks(page)]

    for k in ("video-player", "audio-player", "svg-icon", "object-view", "template-part", "title-bar", "script-x"):
        assert texts(f'<article><p>one</p><{k} src="a"></{k}><p>two</p></article>') == ["one", "two"]
    for k in ("svg", "object", "canvas", "audio", "video", "template", "datalist"):
        assert texts(f"<article><p>one</p><{k} a=1><p>two</p></article>") == ["one", "two"]
        assert texts(f"<p>one</p><{k} a=1>no<p>no</p></{k.upper()} ><p>two</p><{k}/><p>three</p><{k}>") == ["one", "two", "three"]
    for k in ("script", "style", "noscript", "iframe", "textarea", "title"):
        assert texts(f"<p>one</p><{k}>no</{k}><p>two</p><{k} a=1><p>no</p>") == ["one", "two"]
    assert texts("a <svg><path/></svg>b") == ["a b"] and len(texts("<svg>x" * 100_000)) == 1


def test_deep_pages_and_split_references():
    deep = "<div>" * 3000 + "<section><p>one</p></section><p>two</p>" + "</div>" * 3000 + "<article><p>three</p></article>"
    assert [(b.text, b.tag) for b in html_extract.blocks(deep)] == [("one", "p"), ("two", "p"), ("three", "p")] and len(html_extract.blocks(deep)[2].path) == 2
    assert [b.text for b in html_extract.blocks("<p>a &<b>amp;</b> b &amp; c</p>")] == ["a &amp; b & c"]


def test_tags_with_a_quote_that_never_closes():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    assert texts('<p class="un>closed>q</p>') == ["closed>q"]
    assert texts('<div><p class="un>one<p>two</p></div>') == ["one", "two"]
    assert texts("<p title='a>b</p><ul><li>x</ul>") == ["b", "x"]
    assert texts('<p a="x<y>z">ok</p>') == ["ok"] and texts("a < b and c > d") == ["a < b and c > d"]


def test_labeller_against_plain_loops():
    rng = random.Random(5)
    from loamgraph.llm import html_train

    w = html_extract.load_weights()
    pages = [html_extract.blocks(html_train.Site(rng).page()) for _ in range(5)] + [[], html_extract.blocks("<p>one</p>")]
    label = html_extract.Labeller(w)
    sig = lambda v: 1 / (1 + math.exp(-v))

    def direction(xs: list[np.ndarray], k: str) -> list[np.ndarray]:
        units = w[f"{k}_wh"].shape[0]
        h, c, out = np.zeros(units), np.zeros(units), []
        for x in xs:
            a = x @ w[f"{k}_wx"] + h @ w[f"{k}_wh"] + w[f"{k}_b"]
            new_h, new_c = np.zeros(units), np.zeros(units)
            for u in range(units):
                i, f, o, g = (a[u + units * q] for q in range(4))
                new_c[u] = sig(f) * c[u] + sig(i) * math.tanh(g)
                new_h[u] = sig(o) * math.tanh(new_c[u])
            h, c = new_h, new_c
            out.append(h)
        return out

    for page, got in zip(pages, label(pages), strict=True):
        xs = []
        for b in page:
            path = [zlib.crc32(t.encode()) % html_extract.PATH_SLOTS for t in (*b.path, "^" + b.tag)]
            words = [zlib.crc32(t.encode()) % html_extract.WORD_SLOTS for t in b.text.lower().split()]
            xs.append(np.concatenate([sum(w["path"][k].astype(float) for k in path) / math.sqrt(len(path)), sum(w["word"][k].astype(float) for k in words) / len(words), html_extract.numbers(b)]))
        forward, backward = direction(xs, "f"), direction(xs[::-1], "b")[::-1]
        want = [sig(float((f @ w["o_f"] + r @ w["o_b"] + x @ w["o_x"] + w["o"]).item())) for f, r, x in zip(forward, backward, xs, strict=True)]
        assert np.allclose(got, want, atol=1e-4)


def test_whole_page_text_on_new_pages(spark):
    from loamgraph.llm import html_train

    rng = random.Random(77)
    rows, want = [], {}
    for i in range(60):
        page = html_train.Site(rng).page()
        own, y = html_train.labelled(page)
        rows.append((i, "u", page.replace("\ue001", "").replace("\ue000", "")))
        want[i] = Counter(w for b, k in zip(own, y, strict=True) if k > 0 for w in b.text.split())
    got = {r["page_id"]: Counter(r["text"].split()) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    both = sum((got[i] & want[i]).total() for i in want)
    assert both / sum(g.total() for g in got.values()) > 0.97 and both / sum(g.total() for g in want.values()) > 0.97


def test_labeller_on_new_pages():
    from loamgraph.llm import html_train

    rng = random.Random(12345)
    data = [html_train.labelled(html_train.Site(rng).page()) for _ in range(60)]
    label = html_extract.Labeller(html_extract.load_weights())
    right = [((p >= 0.5) == (y > 0)).mean() for p, (_, y) in zip(label([b for b, _ in data]), data, strict=True)]
    assert np.mean(right) > 0.97
