"""Registered text queries: those with SQL next to it, the others in their columns and counts over whole tables."""

import pytest
from compare import connect, differences
from conftest import DATA

import __spark_entry__ as entry
from panelspark.llm.oracles import ORACLES
from panelspark.llm.queries import QUERIES

from llm import test_text_html, test_text_lm as lm, test_text_simhash as simhash, test_text_urls as urls
from panelspark.llm import html_text, tokens

WITHOUT_SQL = {"op2_quality", "op3_main_text", "op4_token_counts", "op6_simhash", "op7_url_rules", "op9_lm_score",
               "op12_token_alignment"}
COLUMNS = {
    "op2_quality": "doc_id held_out score predicted", "op3_main_text": "page_id url text n_chars", "op4_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_simhash": "doc_id fingerprint component_id", "op7_url_rules": "page_id host path rule verdict",
    "op9_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score", "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"}


@pytest.fixture(scope="module")
def results(spark):
    return {name: QUERIES[name](spark, DATA).collect() for name in sorted(WITHOUT_SQL)}


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_registry():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert not differences(QUERIES[name](spark, DATA).toPandas(), connect(DATA).execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_whole_table_and_columns(spark, results, name):
    rows = results[name]
    whole = table(spark, "pages" if "page_id" in COLUMNS[name] else "documents")
    assert len(rows) == whole.count() and list(rows[0].asDict())[:len(COLUMNS[name].split())] == COLUMNS[name].split()


def test_fingerprints_and_components(spark, results):
    import numpy as np

    docs = sorted((r.doc_id, r.text) for r in table(spark, "documents").collect())
    fps = np.array([simhash.fingerprint(t) for _, t in docs], np.uint64)
    want = [(i, f"{int(f):016x}", docs[k][0]) for (i, _), f, k in zip(docs, fps, simhash.roots(fps))]
    assert sorted(map(tuple, results["op6_simhash"])) == want


def test_tokens(spark, results):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in results["op4_token_counts"]:
        assert r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids) and r.n_bytes == len(text[r.doc_id].encode())


def test_base_scores(spark, results):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in results["op9_lm_score"]), key=str)
    assert got == lm.base(docs)


def test_urls(spark, results):
    url = {r.page_id: r.url for r in table(spark, "pages").collect()}
    for r in results["op7_url_rules"]:
        assert (r.host, r.path, r.rule) == urls.expected(url[r.page_id])


def test_pages_are_their_articles(spark, results):
    html = {r.page_id: r.html for r in table(spark, "pages").collect()}
    for r in results["op3_main_text"]:
        assert r.text == html_text.main_text(html[r.page_id]) and r.n_chars == len(r.text)
        inner = html[r.page_id].partition("<article>")[2].partition("</article>")[0]
        assert r.text == html_text.main_text(f"<article>{inner}</article>") or not inner
    assert test_text_html.TEXT


def test_quality_of_held_out_documents(spark, results):
    label = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    held = [r for r in results["op2_quality"] if r.held_out and r.doc_id in label]
    assert held and sum((r.score >= 0.5) == (label[r.doc_id] == 1) for r in held) >= 0.9 * len(held)
