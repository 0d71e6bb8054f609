"""Filter audit, vector codes and suffix-array dedup: odd rows, plain versions, hot keys, and the parts that they are made of."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from netloom.llm import _store, bwt, filter_audit, repeats, vector_codes
from tests.llm.test_odd_rows import documents, labels

# --- filter audit ------------------------------------------------------------------------------------------------


def plain_audit(rows, marks):
    """Every order applied to every row."""
    texts, flags = {}, []
    for doc_id, text, lang, _ in rows:
        if doc_id is not None:
            texts.setdefault(text or "", []).append(doc_id)
    for doc_id, text, lang, _ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        copy = doc_id is not None and min(texts[text]) < doc_id
        fails = dict(A=len(words) < 100, B=100 * len(set(words)) < 80 * len(words), C=100 * len(re.findall("[A-Z]", text)) > 10 * len(text), D=bool(re.search("[#$%&*|]", text)), E=copy)
        flags.append((lang or "", fails, *marks.get(doc_id, (False, False))))
    out = {}
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step in range(5):
                x, before = order[step], order[:step]
                gone = lambda f: any(f[1][b] for b in before)
                here = [f for f in own if f[1][x] and not gone(f)]
                shapley[x] += len(here)
                out[part, "".join(order), step + 1] = [sum(not f[1][x] and not gone(f) for f in own), len(here), sum(f[1][x] and gone(f) for f in own), sum(f[1][x] and sum(f[1].values()) == 1 for f in own), sum(f[2] for f in here), sum(f[3] for f in here), x]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


AUDIT = [(None, None, None, None), (None, "", "en", None), (None, "same", "en", None), (1, "same", "en", None), (1, "same", "en", None), (2, "same", "de", None), (3, "SAME SAME", "", None), (4, " ".join(f"w{i}" for i in range(150)), "en", None)]
AUDIT += [(5, "word " * 200_000, "en", None), (6, " ".join(f"W{i} A" for i in range(100)), "en", None), (7, " ".join(f"w{i}" for i in range(150)), "en", None), (8, " ".join(f"x{i}" for i in range(120)) + " #\t\x0b", "en", None), (9, "Ä Ö " * 3, "fr", None), (10, "", None, None)]


def test_audit_equals_every_order_by_hand(spark):
    got = filter_audit.filter_audit(documents(spark, AUDIT), labels(spark, [(4, 1, 0), (4, None, 1), (5, 0, 1), (None, 1, 1), (7, 1, 0), (8, 1, None)]))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got.collect()}
    assert found == plain_audit(AUDIT, {4: (True, True), 5: (False, True), 7: (True, False), 8: (True, False)})


def test_audit_of_nothing_is_empty(spark):
    assert filter_audit.filter_audit(documents(spark).filter("false"), labels(spark)).count() == 0


# --- vector codes ------------------------------------------------------------------------------------------------


def plain_codes(rows, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1]) // 8
    parts = [[v[p * length : (p + 1) * length] for p in range(8)] for _, v, _ in kept]
    books = [[parts[k][p] for k in range(min(16, len(kept)))] for p in range(8)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e], strict=True)), e))
    for _ in range(rounds):
        for p in range(8):
            groups = {}
            for v in parts:
                groups.setdefault(near(v[p], books[p]), []).append(v[p])
            for e, vs in groups.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out, sums = [], Counter()
    for (i, _, lab), v in zip(kept, parts, strict=True):
        code = [near(v[p], books[p]) for p in range(8)]
        error = sum(sum((a - b) ** 2 for a, b in zip(v[p], books[p][code[p]], strict=True)) for p in range(8))
        out.append((i, "".join(f"{c:02x}" for c in code), error, lab))
        sums[lab] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, sums[lab], digest) for i, c, e, lab in out)


def test_codes_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=32)], int(i) % 3 if i % 5 else None) for i in rng.permutation(300)]
    rows += [(None, rows[0][1], None), (7, rows[1][1], 9), (7, rows[1][1], 9), (400, [0.0] * 32, 1), (401, [-0.0] * 32, 1)]  # ties, repeats, null ids
    odd = [(500, None, 1), (501, [None] + [1.0] * 31, 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] + [0.0] * 31, None), (504, [1.0] * 31, 2), (505, [], 2)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "'x' AS vector", "'y' AS code", "1 AS error")
    got = vector_codes.vector_codes(table.repartition(7))
    assert Counter(tuple(r) for r in got.collect()) == plain_codes(rows)


@pytest.mark.parametrize("rows", [[], [(1, [], 1)], [(1, [1e30] * 8, 1), (2, [-1e30] * 8, None)], [(1, [1.0, 2.0, 3.0], None)]])
def test_codes_of_odd_tables(spark, rows):
    got = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert len(got) == len(rows) and all(r["error"] == 0 for r in got)


@pytest.mark.parametrize("length", [1, 2, 3, 8, 13])
def test_bounds_leave_no_nearest_entry_out(length):
    rng = np.random.default_rng(length)
    for spread in (2, 1000, 1 << 26):
        rows, entries = rng.integers(-spread, spread, (200, length)), rng.integers(-spread, spread, (16, length))
        entries[3] = entries[9]
        rows[:5] = entries[:5]
        d = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        chosen, least = vector_codes.nearest(rows, entries)
        assert (chosen == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        i, j = np.repeat(np.arange(200), 16), np.tile(np.arange(16), 200)
        for starts in vector_codes.block_levels(length):
            assert (vector_codes.lower_bounds(vector_codes.Summary(rows, starts), vector_codes.Summary(entries, starts), i, j) <= d.ravel()).all()


# --- suffix-array dedup --------------------------------------------------------------------------------------------


def prefixes(data, order):
    raw, out = data.tobytes(), [0]
    for a, b in itertools.pairwise(order.tolist()):
        k = 0
        while max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
            k += 1
        out.append(k)
    return np.array(out)


@pytest.mark.parametrize("seed", range(40))
def test_intervals_give_common_prefixes(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + 1 + seed % 4, int(rng.integers(2, 400))).astype(np.uint8)
    data = np.concatenate([data, data[len(data) // 3 :], np.array([255], np.uint8)])
    least = int(rng.integers(9, 70))
    order, shared = bwt.common_prefixes(data, least)
    assert sorted(order.tolist()) == list(range(len(data)))
    assert (shared == np.minimum(prefixes(data, order), least)).all()


def plain_repeats(texts, least):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                gone[i : i + least] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return out


def sentence(rng, n):
    return " ".join(str(x) for x in rng.integers(0, 5000, n))


def test_repeats_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    shared, other = sentence(rng, 60), sentence(rng, 45)
    texts = [None, "", "short", "a" * 200, "ab" * 150, "ab" * 150, "é" * 130, sentence(rng, 30) + shared + sentence(rng, 30), shared, other + shared[50:290], sentence(rng, 20) + other, "x" * 199, "x" * 199, "\0" * 210, "\0" * 5 + sentence(rng, 50)]
    texts += [sentence(rng, 3) + shared[: 200 + k] + sentence(rng, 25 + k) for k in range(12)]
    rows = [(i if i % 4 else None, t, "en", "web") for i, t in enumerate(texts)]
    for options in ({}, {"block": 2, "chunk": 2000}, {"least": 60, "gram": 12, "block": 3}):
        got = Counter(tuple(r) for r in repeats.remove_repeats(documents(spark, rows).repartition(5), **options).collect())
        assert got == Counter((r[0], *p) for r, p in zip(rows, plain_repeats(texts, options.get("least", 200)), strict=True)), options


def test_repeats_in_long_texts_and_nothing(spark):
    rng = np.random.default_rng(2)
    long = sentence(rng, 900_000)  # over four pieces
    passage = long[1_040_000:1_060_000]  # over the end of a piece
    got = {r["doc_id"]: r for r in repeats.remove_repeats(documents(spark, [(1, long, "en", "web"), (2, "other|" + passage + "|end", "en", "web")])).collect()}
    assert got[1]["n_removed"] == got[2]["n_removed"] == len(passage)
    assert got[1]["kept_sha256"] == hashlib.sha256((long[:1_040_000] + long[1_060_000:]).encode()).hexdigest()
    assert repeats.remove_repeats(documents(spark).filter("false")).count() == 0


def test_many_different_slices_of_one_anchor_are_split(spark):
    rng = np.random.default_rng(3)
    line = "the one line that stands in each of them, and no passage of two hundred bytes does"
    texts = [f"{sentence(rng, 40)} {line} {sentence(rng, 40)}" for _ in range(60)]
    texts += [texts[k][100:420] for k in range(0, 60, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [tuple(r)[1:] for r in sorted(repeats.remove_repeats(docs, block=4, chunk=3000).collect())]
    assert got == plain_repeats(texts, 200)


def test_near_copies_make_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    passage = sentence(rng, 120)
    texts = []
    for k in range(240):
        at = int(rng.integers(0, len(passage)))
        texts.append(f"{passage[:at]}<{k}>{passage[at:]}")
    rows, write = [], repeats.materialize

    def counted(df, tag, *more):
        table = write(df, tag, *more)
        rows.append((table.count(), tag))
        return table

    monkeypatch.setattr(repeats, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [tuple(r)[1:] for r in sorted(repeats.remove_repeats(docs, block=8, chunk=3000).collect())]
    assert got == plain_repeats(texts, 200)
    slices = dict((t, n) for n, t in rows)["repeats-slices"]
    assert max(rows)[0] <= 4 * slices, sorted(rows)


# --- look-ups ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [0, 1, 2, 100])
def test_look_up_of_hot_keys(spark, monkeypatch, most):
    monkeypatch.setattr(_store, "HOT_KEYS", most)
    rows = spark.createDataFrame([(1 if i < 3000 else 2 if i < 3900 else 3 if i < 4300 else i, i) for i in range(4400)] + [(None, -1)], "k bigint, i bigint")
    table = rows.filter("k IS NOT NULL AND k % 10 <> 5").select("k", (rows["k"] * 3).alias("v")).distinct()
    got = Counter(tuple(r) for r in _store.look_up(rows, table, "k").select("k", "i", "v").collect())
    assert got == Counter((r["k"], r["i"], r["k"] * 3) for r in rows.collect() if r["k"] is not None and r["k"] % 10 != 5)
    hot = _store.hot_keys(rows.groupBy("k").agg({"i": "count"}).toDF("k", "__rows"))
    assert (0 if hot is None else hot.count()) == {0: 0, 1: 1, 2: 2, 100: 3}[most]
