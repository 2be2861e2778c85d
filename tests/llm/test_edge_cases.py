"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postsift.llm import (bpe, chats, lines, mixing, pages, passages, quality, simhash,
                          sketches, urls)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "key", "fp", "mark", "n", "ids", "number", "size", "bucket", "dropped", "votes", "kept", "host"]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

OPERATORS = {
    "report": mixing.report, "mix": mixing.mix_documents, "edits": sketches.compare_with_edits,
    "encode": lambda d: bpe.encode_documents(d, VOCABULARY), "prints": simhash.near_duplicates,
    "keep_one": simhash.keep_one, "keep_good": quality.keep_good, "lines": lines.report,
    "drop_repeats": lines.drop_repeats, "passages": passages.repeated_passages}
# Operators that return the columns they were given.
KEEPING = {"mix", "keep_one", "keep_good", "drop_repeats"}


def awkward(spark):
    prose = " ".join(f"w{i % 97}x{i}" for i in range(60))
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, prose, "en", None, 1), (3, None, None, None, None),
            (None, prose, "en", "b", 1), (None, None, None, None, None), (4, "", "en", "a", 0),
            (5, " \n\t ", "en", "a", 4), (6, "one", "en", "b", 3), (7, "x" * 300_000, "en", "b", 300_000),
            (8, "long words here " * 20_000, "en", "c", 320_000), (9, "\n" * 5000, "en", "c", 5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(i))
    return df


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    df = awkward(spark)
    out = OPERATORS[name](df)
    rows = out.collect()
    if name in KEEPING:
        assert out.columns == df.columns
    if name in ("report", "edits", "prints", "lines", "encode", "drop_repeats"):
        assert len(rows) == 12
    if name == "keep_one":
        assert sorted((r.doc_id is None, r.doc_id) for r in rows) == [
            (False, 1), (False, 3), (False, 6), (False, 7), (False, 8)]
    if name == "keep_good":
        assert {r.doc_id for r in rows} == {1, 2, None}
    if name == "passages":
        assert {(r.doc_id, r.first) for r in rows} == {(1, True), (2, False)}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None), (None, 1, "u", "x"), (1, None, None, "y"), (1, None, None, "y")]])
def test_chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    assert chats.format_chats(df).count() == (2 if rows else 0)


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, "http://a/", ""), (2, "http://a/", "<p>" * 3000 + "x"),
                                       (2, "http://a/", "<p>" * 3000 + "x"), (3, "x", "<!-- <p>no"), (4, "http://a/", "&lt;b&gt; &amp;amp;")]])
def test_pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1))
    got = {r.page_id: r.text for r in pages.main_text(df).select("row.page_id", "text").collect()}
    assert got == ({1: "", None: "", 2: "x", 3: "", 4: "<b> &amp;"} if rows else {})
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert urls.judge(df, urls.labelled_urls(df, labels)).count() == len(rows)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        sizes.append(docs.count())
        assert docs.columns == kinds + (["ids"] if name == "encoding" else [])
        if name != "encoding":
            assert docs.where("n_chars <> length(text)").count() == 0
    assert sizes[0] == sizes[1] > sizes[2] and sizes[3] == sizes[4]
    assert docs.where("size(ids) = 0").count() == 0


def test_hashes_of_several_documents_move_once(spark):
    rows = [(d, at, h) for d, at, h in ((1, 0, 7), (1, 1, 7), (2, 5, 8), (3, 0, 7), (9, 2, 6), (4, 4, 6), (4, 5, 6))]
    found = passages._in_several(spark.createDataFrame(rows, "doc long, at long, h long"), "h")
    assert sorted((r.doc, r.at, r.h, r.a) for r in found.collect()) == [
        (1, 0, 7, 1), (1, 1, 7, 1), (3, 0, 7, 1), (4, 4, 6, 4), (4, 5, 6, 4), (9, 2, 6, 4)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Window") == 1
