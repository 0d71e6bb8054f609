import re
from collections import Counter

from netloom.llm import quality_rules as q

TEXTS = [None, "", "   \n", "one", "a b c d e a b c d e", "x " * 40, "line one\nline one\n\nother #$\nline one", "ä ö ü " * 5 + "!!", "a b c d e f a b c d e f g h i j", "  lead and tail \t\n", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "one\x0btwo\x0cthree\rfour"]


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, kept string")
    rows = {r["doc_id"]: r for r in q.quality_rules(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), t
        assert not (r["base_failed"] and r["kept"])


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in q.quality_rules(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]])


def test_empty_table(spark):
    assert q.quality_rules(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_kept_rows_are_those_marked(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, "the cat is on the mat and the dog in it of to be"])], "doc_id bigint, text string, kept string")
    marked = {r["doc_id"] for r in q.quality_rules(docs).collect() if r["kept"]}
    kept = q.kept_rows(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == marked and marked
