"""The registered queries against their SQL on the smallest tables, and the pipeline against its parts."""

from __future__ import annotations

import pytest

import corpus_pipeline
from loamgraph.llm import queries as Q
from loamgraph.llm.common import table
from tests.conftest import SF, normal


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        now = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == columns and now <= before and len(now) > 0.6 * len(before)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == before
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == before


def test_language_and_toxicity_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    got = [r for r in Q.op2_language_id(spark, SF).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.97 * len(got)
    assert Q.op3_toxicity(spark, SF).count() == len(lang)


def test_extraction_of_the_given_pages(spark):
    import html
    import re

    def gold(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", "\n", body))).split())

    want = {r["page_id"]: gold(r["html"]) for r in table(spark, SF, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in Q.op10_html_extraction(spark, SF).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)
