"""Whole small tables against plain Python."""

import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from netloom.llm import _text, lm_scoring, mixing, ngram_join, queries

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    wanted = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(wanted.fetchall())


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def test_join_finds_planted_copies(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:150] + ["x"] + base[151:]), " ".join(base[:280]), " ".join(base[100:]), None, "", "one two", "one two", "one three", " ".join(f"v{i}" for i in range(60))]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, bucket string")
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and near(grams[i], grams[j])]
    rows = {r["doc_id"]: r for r in ngram_join.ngram_jaccard_join(docs).collect()}
    for i in range(len(texts)):
        assert rows[i]["n_links"] == sum(a == i for a, _ in pairs), i
    assert [rows[i]["class_id"] for i in range(len(texts))] == [0, 0, 0, 0, 4, 5, 5, 7, 7, 9, 10]
    kept = ngram_join.keep_one_of_each_class(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 4, 5, 7, 9, 10]


def test_hot_bucket_is_compared_in_blocks(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole, cut = ({tuple(r) for r in ngram_join.ngram_jaccard_join(docs, block=b).collect()} for b in (512, 7))
    assert whole == cut and {r[2] for r in whole} == {59}


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


@pytest.mark.parametrize("rate", [0.0, 0.3, 4.0, 800.0, 1e6])
def test_poisson_steps(rate):
    least, steps = mixing.poisson_steps(rate)
    assert abs(steps[-1] - 1) < 1e-6 and len(steps) <= 25 * math.sqrt(rate) + 100
    mean = sum((least + i) * p for i, p in enumerate([steps[0], *(b - a for a, b in zip(steps, steps[1:]))]))
    assert abs(mean - rate) <= 1e-5 * max(rate, 1)
    if rate == 4.0:
        assert abs(steps[3] - sum(math.exp(-4) * 4**k / math.factorial(k) for k in range(4))) < 1e-12


def test_mixing_reaches_the_weights(spark):
    docs = spark.createDataFrame([(i, f"text of {i:05d}", "a" if i % 10 else "b") for i in range(5000)], "doc_id bigint, text string, source string")
    got = mixing.mix_sources(docs, {"a": 0.5, "b": 0.5}).groupBy("source").count().collect()
    share = {r["source"]: r["count"] for r in got}
    assert abs(share["a"] / 2500 - 1) < 0.1 and abs(share["b"] / 2500 - 1) < 0.1


def test_both_joins_of_rates_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", None if i % 3 else "b") for i in range(300)], "doc_id bigint, text string, source string")
    one = sorted(map(tuple, mixing.mix_sources(docs).drop("source").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", 0)
    assert sorted(map(tuple, mixing.mix_sources(docs).drop("source").collect())) == one


def test_base_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame([(900001, None), (900002, ""), (900003, "Ähm ONE one \x0b two")], "doc_id bigint, text string"), allowMissingColumns=True)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*words(t.translate(lower)), None] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(docs).collect()}
    assert len(rows) == len(texts)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(w in counts for w in ws), n)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert abs(r["base_score"] - base) <= 1e-9 * max(1, abs(base))
        assert r["score"] <= 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_shingles_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["a b c d e f", "x " * 9, "", "long" * 40 + " b c d e"]
    whole = [s.tolist() for s in _text.shingle_sets(pa.array(texts))]
    assert whole == [next(_text.shingle_sets(pa.array([t]))).tolist() for t in texts]


def test_lm_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, other = ({r["doc_id"]: r for r in lm_scoring.score_documents(d).collect()} for d in (docs.coalesce(1), docs.orderBy("text").repartition(5, "n_chars")))
    for i, r in one.items():
        assert abs(r["base_score"] - other[i]["base_score"]) <= 1e-9 * abs(r["base_score"])
        assert abs(r["score"] - other[i]["score"]) <= 1e-4 * abs(r["score"])


def test_frequent_words_come_in_order(spark):
    counts = spark.createDataFrame([(i, i % 7 * 100 + i % 3) for i in range(500)], "word bigint, n bigint")
    keys, n = lm_scoring.frequent_words(counts, 40)
    wanted = sorted(((-(i % 7 * 100 + i % 3), i) for i in range(500)))[:40]
    assert list(zip((-n).tolist(), keys.tolist())) == wanted


def test_repeats_cost_no_more_than_one(spark, monkeypatch):
    """A row repeated 20,000 times, null ids included, is one node: no group compares it more than once."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base)] * 20_000 + [(None, base)] * 20_000 + [(2, base + " x"), (3, "other words stand here alone today")]
    out = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("doc_id", "class_id", "n_links").count().collect()
    got = {r["doc_id"]: (r["n_links"], r["count"]) for r in out}
    assert got == {1: (40_000, 20_000), None: (40_000, 20_000), 2: (40_000, 1), 3: (0, 1)}
    assert len({r["class_id"] for r in out if r["doc_id"] != 3}) == 1


def test_look_up_of_hot_keys(spark):
    from netloom.llm import _store

    rows = spark.createDataFrame([(0, i) for i in range(1000)] + [(i, i) for i in range(1, 50)], "k bigint, x bigint")
    table = spark.createDataFrame([(i, i * 2) for i in range(0, 40)], "k bigint, y bigint")
    plain = sorted(map(tuple, rows.join(table, "k").collect()))
    assert sorted(map(tuple, _store.look_up(rows, table, "k").select("k", "x", "y").collect())) == plain


def test_packed_sequences_hold_every_id(spark):
    """Whole table, and repeated rows: sequences are gapless, and their ids are those of each text by the tokenizer itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from netloom.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.filter("doc_id < 5")).union(spark.createDataFrame([(None, None), (7_000, "word " * 9000)], docs.schema))
    placed = packing.pack_documents(docs, path)
    rows = placed.collect()
    assert len({(r["row_id"], r["piece"]) for r in rows}) == len(rows)
    tokenizer = Tokenizer.from_file(path)
    wanted = Counter(tuple([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect())
    texts = {}
    for r in docs.collect():
        texts[r["doc_id"]] = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
    sequences = {r["sequence_id"]: r["ids"] for r in packing.packed_ids(docs, placed, path).collect()}
    filled = Counter()
    whole = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled[r["sequence_id"]] == r["offset"]
        filled[r["sequence_id"]] += r["length"]
        own = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == own
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)) == r["ids_crc32"]
        whole.setdefault(r["row_id"], {})[r["piece"]] = own
    assert max(filled.values()) <= 2048 and {k: len(v) for k, v in sequences.items()} == dict(filled)
    assert Counter(tuple(i for p in sorted(v) for i in v[p]) for v in whole.values()) == wanted
    assert len(filled) <= sum(map(len, texts.values())) / 2048 * 1.05 + 2


def test_uniform_histogram_is_packed_near_the_bound():
    import numpy as np

    from netloom.llm import packing

    histogram = np.bincount(np.random.default_rng(1).integers(1, 2049, 20_000), minlength=2049)
    sequences = sum(n for _, n in packing.make_plan(histogram))
    bound = -(-int((histogram * np.arange(2049)).sum()) // 2048)
    assert sequences <= 1.02 * bound


def test_class_prior_and_risk_on_known_mixtures(spark):
    """Positives and unlabelled rows from known distributions: the prior is found, and rows are told apart without a labelled negative."""
    import numpy as np

    from netloom.llm import pu_quality as pu

    for share in (0.2, 0.5, 0.8):
        rng = np.random.default_rng(int(share * 10))
        p = rng.normal(1, 1, (1500, 4))
        is_p = rng.random(6000) < share
        u = np.where(is_p[:, None], rng.normal(1, 1, (6000, 4)), rng.normal(-1, 1, (6000, 4)))
        first = pu.descend(pu.start_network(4), p[::2], u, None, 6, 0.01)
        z = pu.output(first, p[1::2])
        cuts = np.unique(np.quantile(z, np.linspace(0.02, 0.9, 45)))
        counts = np.bincount(np.searchsorted(cuts, pu.output(first, u), "right"), minlength=len(cuts) + 1)
        prior = pu.estimate_prior(z, cuts, counts)
        assert abs(prior - share) < 0.07, (share, prior)
        net = pu.descend(pu.start_network(4), p, u, prior, 15, 0.01)
        assert ((pu.output(net, u) > 0) != is_p).mean() < 0.06
    # the unbiased part below 0: the step leads away from it
    z = np.array([3.0, 3.0])
    assert (pu.risk_slopes(z, -z, 0.9)[:2] > 0).all() and (pu.risk_slopes(z, -z, 0.9)[2:] < 0).all()


def test_quality_of_held_out_rows(spark):
    from netloom.llm import pu_quality as pu

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = pu.score_quality(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 500 and sum(r["predicted"] != r["quality"] for r in rows) <= 0.02 * len(rows)


def test_toxicity_of_held_out_rows(spark):
    from netloom.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).filter("held_out").join(labels.filter("toxic IS NOT NULL"), "doc_id").collect()
    assert len(rows) > 500 and sum(r["predicted"] != r["toxic"] for r in rows) <= 0.02 * len(rows)
    assert len({r["score"] for r in rows}) > 1 and all(0 <= r["score"] <= 1 for r in rows)


def test_mined_rules_equal_counting(spark):
    """Every antecedent of up to three tokens counted by hand; companions that stand in the same rows count once."""
    import random
    from itertools import combinations

    from netloom.llm import url_rules

    rng = random.Random(4)
    rows = []
    for _ in range(400):
        tokens = {t for t in "abcdef" if rng.random() < 0.4}
        bad = {"a", "b"} <= tokens or "f" in tokens and rng.random() < 0.9
        rows.append((sorted(tokens | ({"a2"} if "a" in tokens else set()) | {f"one{rng.random()}"}), "block" if bad else "allow"))
    got = {(tuple(r["antecedent"]), r["verdict"]): round(r["confidence"], 9) for r in url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8).collect()}
    base = Counter(v for _, v in rows)
    wanted = {}
    for k in (1, 2, 3):
        for items in combinations("abcdef", k):
            has = [v for t, v in rows if set(items) <= set(t)]
            for verdict, n in Counter(has).items():
                confidence = n / len(has)
                if n >= 0.05 * len(rows) and confidence >= 0.8 and confidence / (base[verdict] / len(rows)) >= 1.2:
                    parts = [p for j in range(1, k) for p in combinations(items, j)]
                    if not any(wanted.get((p, verdict, "all"), 0) >= confidence for p in parts):
                        wanted[(items, verdict)] = round(confidence, 9)
                    wanted[(items, verdict, "all")] = confidence
    assert got and got == {k: v for k, v in wanted.items() if len(k) == 2}


def test_mined_verdicts_reach_urls_without_a_rule(spark):
    from netloom.llm import url_rules

    urls = [f"http://x{i}.example.com/de/{i}" for i in range(60)] + [f"http://x{i}.example.com/fr/{i}" for i in range(60)] + ["http://new.example.net/de/5", "http://new.example.net/fr/5", "http://new.example.net/it/5"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    out = {r["page_id"]: r for r in url_rules.judge_urls(pages).collect()}
    assert [(out[k]["rule"], out[k]["verdict"]) for k in (120, 121, 122)] == [(None, "block"), (None, "allow"), (None, "allow")]
    assert out[120]["mined_confidence"] >= 0.8 and out[122]["mined_confidence"] is None
