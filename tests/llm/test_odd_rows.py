"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from netloom.llm import licenses, lm_scoring, media, mixing, ngram_join, packing, pu_quality, quality_rules, toxicity, url_rules

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = "the cat and the dog sat on the mat in the house by the river and it was a fine day for all of us number {}"
ROWS = [(None, None, None, None), (None, "text without id", "en", "web"), (1, None, "en", None), (2, "", None, "web"), (3, "word " * 60_000, "en", "web"), (4, "same text here", "en", "web"), (4, "same text here", "en", "web"), (5, "same text here", "de", "books"), (6, " \t\n\x0b", "en", "web"), (7, "ÄÖ \U0001f600   ﻿", "en", "web")]
ROWS += [(10 + i, PLAIN.format(i), "en", "web") for i in range(30)]
CLASH = "score text_digest label block path file_id features copy row kept held_out q_text q_list q_row __text __id __digest __steps __identity __draw __score identity draw steps least source_ text2 row_id id digest passed"


def documents(spark, rows=ROWS):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in CLASH.split():
        docs = docs.selectExpr("*", f"'extra' AS `{name}`")
    return docs


def labels(spark, rows=((1, 1, 0), (2, None, 1), (None, 1, 1), (4, 0, None), (4, 1, 0), (10, 1, 0), (11, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int").selectExpr("*", "'extra' AS text", "'extra' AS label")


OPERATORS = {
    "mixing": lambda s, d: mixing.mix_sources(d),
    "join": lambda s, d: ngram_join.ngram_jaccard_join(d),
    "lm": lambda s, d: lm_scoring.score_documents(d),
    "quality": lambda s, d: pu_quality.score_quality(d, labels(s)),
    "packing": lambda s, d: packing.pack_documents(d, TOKENIZER),
    "media": lambda s, d: media.media_digests(d),
    "rules": lambda s, d: quality_rules.quality_rules(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "licences": lambda s, d: licenses.license_scan(licenses.documents_as_files(d)),
    "urls": lambda s, d: url_rules.judge_urls(d.selectExpr("doc_id AS page_id", "text AS url", "lang AS host", "source AS rule", "'x' AS verdict")),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operator_on_odd_rows(spark, name):
    rows = OPERATORS[name](spark, documents(spark)).collect()
    if name == "packing":
        assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in rows}) == len(rows) >= len(ROWS)
        for r in rows:
            assert 0 <= r["offset"] and r["offset"] + r["length"] <= 2048
    elif name != "mixing":
        assert len(rows) == len(ROWS)
    for column in {"score", "predicted", "kept", "verdict", "n_links", "payload_sha256"} & set(rows[0].asDict()):
        assert name == "licences" or all(r[column] is not None for r in rows), column


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operator_on_an_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark).filter("false")).count() == 0


PASSING = {
    "rules": lambda s, d: quality_rules.kept_rows(d),
    "quality": lambda s, d: pu_quality.keep_good(d, labels(s)),
    "join": lambda s, d: ngram_join.keep_one_of_each_class(d),
    "mixing": lambda s, d: mixing.mix_sources(d.drop("copy")),
    "rules with columns": lambda s, d: quality_rules.quality_rules(d.drop("kept")),
}


@pytest.mark.parametrize("name", list(PASSING))
def test_extra_columns_pass_unharmed(spark, name):
    out = PASSING[name](spark, documents(spark))
    extra = [c for c in CLASH.split() if c in out.columns and c not in ("copy", "kept")]
    assert len(extra) >= 28
    rows = out.select(*extra).distinct().collect()
    assert [set(r) for r in rows] == [{"extra"}]


def test_stages_on_odd_rows_and_nothing(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark)
    for start in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, start, str(tmp_path))
            out.collect()
            if name != "best_fit_packing":
                assert out.columns == corpus_pipeline.COLUMNS, name


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    rows = [*ROWS, (90, PLAIN.format(0), "en", "web")]
    documents(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, rows).select(*corpus_pipeline.COLUMNS)
    passed = {r["doc_id"] for r in quality_rules.quality_rules(docs).collect() if r["kept"]}
    assert passed == {*range(10, 40), 90}
    docs = docs.filter(docs["doc_id"].isin(list(passed)))
    good = {r["doc_id"] for r in pu_quality.score_quality(docs, labels(spark)).filter("score >= 0.3").collect()}
    docs = docs.filter(docs["doc_id"].isin(list(good)))
    one = {r["doc_id"] for r in ngram_join.ngram_jaccard_join(docs).filter("kept").collect()}
    docs = docs.filter(docs["doc_id"].isin(list(one)))
    copies = mixing.mix_sources(docs).count()
    assert 0 < len(one) < len(good) == len(passed)
    assert corpus_pipeline.run(spark, str(tmp_path)).filter("piece = 0").count() == copies
