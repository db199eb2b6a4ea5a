"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import os

import pytest
from pyspark.sql import functions as F

from vellumine.llm import chat, decontamination, html_text, mixing, near_copies, pii, simhash, stages, token_store, topk, toxicity, url_filter
from vellumine.llm.queries import TOKENIZER, URL_RULES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, `__vq_c0` string, size string, `a.b` string"
LONG = "word " * 40_000


def rows(*texts):
    return [(None if i == 1 else i, t, None, None if i % 3 == 0 else "s", None, 0.5, "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    some = rows("plain words here and there", "a row without an id", None, "", " \t\n", LONG, "😀 é ß", "plain words here and there")
    return spark.createDataFrame([*some, some[0], some[2]], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    texts = [f"fine words number {i} go on" for i in range(30)] + [f"fine words {'slurry' if i % 2 else 'cursed'} number {i} go on" for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 30)) for i in range(60)] + [(None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (None, "x y"), (3, "")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("stage", [stages.drop_toxic, stages.drop_near_duplicates, stages.drop_contaminated, stages.mix_sources])
def test_stages_keep_columns(spark, odd, none, folder, stage):
    for docs in (odd, none):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        n = out.count()
        assert n == 0 if docs is none else n > 0


def test_clean_documents_stay(spark, odd, folder):
    assert stages.drop_contaminated(spark, odd, folder).count() == odd.count()
    assert stages.drop_toxic(spark, odd, folder).count() == odd.count()


def test_last_stage(spark, odd, none, folder):
    assert stages.store_tokens(spark, none, folder).count() == 0
    got = stages.store_tokens(spark, odd, folder).orderBy("start").collect()
    assert len(got) == odd.count() and got[0].doc_id is None and got[0].start == 0
    for a, b in zip(got, got[1:]):
        assert a.start + a.n_tokens == b.start


def test_near_duplicates_of_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    zero = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in zero} == {2, 3, 4} and {r.component_id for r in zero} == {2}
    assert [r.component_id for r in got if r.doc_id in (0, 7)] == [0, 0, 0]


def test_one_row_of_each_group_stays(spark):
    a, b, c = ("some words that make a text of their own here", "quite another text with other words in it now", "a third text that nothing else looks like at all")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (2, c), (None, b), (None, "only rows without an id say this one thing"), (None, "only rows without an id say this one thing"), (3, c), (3, c)], "doc_id bigint, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in near_copies.without_near_copies(docs).collect())
    assert kept == sorted([(1, a), (1, b), (2, c), (0, "only rows without an id say this one thing")])


def test_mixing_of_odd_rows(odd, none):
    assert mixing.mix(none).count() == 0
    got = mixing.mix(odd, quality=F.lit(None).cast("double")).collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if r["size"] == 0) and all(r.taken <= 3 * r["size"] for r in got)


def test_decontamination_of_odd_rows(spark, odd, none, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontamination.find_overlaps(none, bench).count() == 0
    assert decontamination.find_overlaps(odd, bench.limit(0)).filter(F.size("items") > 0).count() == 0
    assert {r.doc_id: r.n_words for r in decontamination.find_overlaps(odd, bench).collect()}[2] == 0


def test_toxicity_without_labels(spark, odd, none, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert toxicity.train(odd, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    machine = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    got = toxicity.score(odd, machine).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, machine).count() == 0


def test_pii_of_odd_rows(spark, odd, none):
    assert pii.find_pii(none).count() == 0
    assert pii.find_pii(odd).filter(F.size("spans") > 0).count() == 0
    twice = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co")], "doc_id bigint, text string")
    assert [len(r.base) for r in pii.find_pii(twice).collect()] == [1, 1, 1]


def test_chat_of_odd_rows(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, formatted string, last string"
    turns = [(1, 0, "user", None, "a", "b"), (1, 1, "assistant", "", "a", "b"), (1, 1, "assistant", "", "a", "b"), (2, None, None, "x", "a", "b"), (None, 0, "assistant", LONG, "a", "b")]
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(spark.createDataFrame(turns, kind))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns, got[2].loss_chars, got[None].loss_chars) == (3, 0, 1, 0, len(LONG))
    assert chat.conversation_digests(chat.format_conversations(spark.createDataFrame([], kind))).count() == 0


def test_pages_of_odd_rows(spark):
    kind = "page_id bigint, url string, html string, text string, host string"
    pages = spark.createDataFrame([(1, None, None, "a", "b"), (2, "no scheme", "", "a", "b"), (2, "no scheme", "", "a", "b"), (3, "HTTP://A.Example.COM/en/x?q", "<p>" * 3000, "a", "b"), (4, "http://h", "<p>" + LONG, "a", "b")], kind)
    assert html_text.extract(pages.limit(0)).count() == 0
    texts = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert texts[1] == texts[2] == texts[3] == "" and len(texts) == 4
    judged = url_filter.judge_urls(pages, URL_RULES).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judged if r.page_id in (1, 3)) == [(1, "", "", None, "allow"), (3, "a.example.com", "/en/x", "com/en/", "block")]
    assert len(judged) == 5 and url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_vectors_of_odd_rows(spark):
    kind = "vec_id bigint, embedding array<float>, score string, rank string"
    nan, inf = float("nan"), float("inf")
    rows_ = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0]), (None, [9.0, 9.0]), (8, [1.0, 2.0]), (9, [0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "a", "b") for r in rows_], kind)
    got = topk.top_k(vectors, F.col("vec_id") == 0, k=10).orderBy("rank").collect()
    # Both rows of id 0 ask, and each is a partner of the other.
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == sorted(2 * [(1, 0, 5 * 1024**2), (2, 8, 5 * 1024**2), (3, 6, 1024**2), (4, 5, 0), (5, 9, 0)])
    assert topk.top_k(vectors.limit(0), F.col("vec_id") == 0).count() == 0


def test_store_of_an_empty_table(spark, none):
    store = token_store.write_store(none, TOKENIZER)
    assert token_store.read_documents(spark, store).count() == 0 and len(token_store.store_root(spark, store)) == 32
    assert os.path.isdir(store.path.removeprefix("file://"))
