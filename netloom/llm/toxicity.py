"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

A lexicon is learned as word stems (byte prefixes and whole words) that stand in toxic training texts far
more often than in others, beside a short fixed list. Features are lexicon densities, how close hits
stand to second-person words, capitals, punctuation and obfuscation rates. ``GBTClassifier`` is fitted on
one part of a bounded labelled sample and ``IsotonicRegression`` on the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _dense, _text
from ._labels import fold, labelled_sample
from ._store import materialize

#: Labelled rows used for fitting, at most.
FIT_ROWS = 20_000
#: Stems kept in the learned lexicon, at most; strongest first.
LEXICON_SIZE = 4_000
PREFIXES = (4, 5, 6)

INSULTS = (
    "idiot idiots moron morons stupid loser losers clown scum trash worthless pathetic disgusting dumb fool jerk "
    "dummkopf trottel arschloch depp abschaum connard imbécile crétin salaud ordure tonto estúpido imbécil basura cabrón"
).split()
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi vous votre ton ta tú ti usted vosotros".split()

FEATURES = 32


def _hash_words(words: list[str]) -> np.ndarray:
    data, at = _text.utf8(pa.array(words, pa.large_string()))
    return np.sort(_text.span_hashes(data, at[:-1], at[1:]))


_INSULTS, _SECOND = _hash_words(INSULTS), _hash_words(SECOND_PERSON)
#: Digits and marks written for letters.
_LEET = np.arange(256, dtype=np.uint8)
for _mark, _letter in zip(b"013457@$!", b"oieastasi", strict=True):
    _LEET[_mark] = _letter


def _within(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted ones, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[place] == keys, place, -1)


def stem_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For every word, the keys of its prefixes and of itself; a prefix as long as the word is 0 (none)."""
    keys = []
    for k in PREFIXES:
        long = ends - starts > k
        key = np.zeros(len(starts), np.uint64)
        key[long] = _text.mix(_text.span_hashes(data, starts[long], starts[long] + k) + np.uint64(k))
        keys.append(key)
    keys.append(_text.mix(_text.span_hashes(data, starts, ends) + np.uint64(99)))
    return keys


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = _text.utf8(batch.column("text"))
        label = np.asarray(batch.column("label"))
        for a, b in _text.chunks(data, at):
            part, offs = _text.LOWER[data[at[a] : at[b]]], at[a : b + 1] - at[a]
            starts, ends, first = _dense.letter_runs(part, offs)
            owner = np.repeat(np.arange(b - a), np.diff(first))
            keys = np.concatenate(stem_keys(part, starts, ends))
            owner = np.tile(owner, len(PREFIXES) + 1)[keys != 0]
            keys = keys[keys != 0]
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            keys, owner = keys[new], owner[new]
            once, group = np.unique(keys, return_inverse=True)
            toxic = np.bincount(group, label[a + owner], minlength=len(once)).astype(np.int64)
            total = np.bincount(group, minlength=len(once))
            yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(toxic), pa.array(total.astype(np.int64))], ["key", "toxic", "total"])


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE, support: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted stem keys and their log-odds, from ``(text, label)`` rows: at least ``support`` toxic texts."""
    n = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    toxic, total = float(n[0] or 0), float(n[1] or 0)
    counts = sample.mapInArrow(_stem_counts, "key bigint, toxic bigint, total bigint").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
    odds = F.ln((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.ln((F.col("total") - F.col("toxic") + 0.5) / F.lit(total - toxic + 1.0))
    best = counts.filter(F.col("toxic") >= support).withColumn("odds", odds).filter("odds > 2.5").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "key").limit(size).collect()
    keys = np.array([r["key"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["odds"] for r in best], np.float64)[order]


def features(data: np.ndarray, at: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text; all are defined for the empty text."""
    keys, odds = lexicon
    n = len(at) - 1
    lower = _text.LOWER[data]
    starts, ends, first = _dense.letter_runs(lower, at)
    words = np.maximum(np.diff(first), 1)
    weight = np.zeros(len(starts))
    for key in stem_keys(lower, starts, ends):
        place = _within(keys, key)
        weight = np.maximum(weight, np.where(place >= 0, odds[place] if len(odds) else 0.0, 0.0))
    hit = weight > 0
    plain = _text.span_hashes(lower, starts, ends)
    insult = _within(_INSULTS, plain) >= 0
    second = _within(_SECOND, plain) >= 0
    owner = np.repeat(np.arange(n), np.diff(first))
    any_hit = hit | insult
    near = np.zeros(len(starts), bool)
    for gap in range(1, 6):
        same = owner[gap:] == owner[:-gap]
        near[gap:] |= any_hit[gap:] & second[:-gap] & same
        near[:-gap] |= any_hit[:-gap] & second[gap:] & same
    strongest = np.zeros(n)
    np.maximum.at(strongest, owner, weight)
    # obfuscation: letters and digits or marks mixed within one space-separated word, and long runs
    w_starts, w_ends, w_first = _text.words(data, at)
    leet = _LEET[lower]
    inner = np.concatenate([[0], np.cumsum(~_dense.LETTER[data] & _dense.LETTER[leet])])
    letters = np.concatenate([[0], np.cumsum(_dense.LETTER[data])])
    w_inner, w_letters = inner[w_ends] - inner[w_starts], letters[w_ends] - letters[w_starts]
    mixed = (w_inner > 0) & (w_letters > 1)
    unmasked = np.zeros(len(w_starts), bool)
    if mixed.any():
        unmasked[mixed] = _within(_INSULTS, _text.span_hashes(leet, w_starts[mixed], w_ends[mixed])) >= 0
    upper = (data >= 65) & (data <= 90)
    shouted = np.concatenate([[0], np.cumsum(upper)])
    loud = (shouted[ends] - shouted[starts] == ends - starts) & (ends - starts > 2)
    run = np.zeros(len(data), bool)
    run[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _dense.LETTER[data[2:]]
    per_word = lambda x: _dense.sums(x, first) / words
    space_words = np.maximum(np.diff(w_first), 1)
    columns = [
        np.log1p(np.diff(first)),
        _dense.sums(hit, first),
        per_word(hit),
        _dense.sums(weight, first),
        strongest,
        _dense.sums(insult, first),
        per_word(insult),
        _dense.sums(near, first),
        per_word(near),
        per_word(second),
        per_word(loud),
        _dense.sums(mixed, w_first) / space_words,
        _dense.sums(unmasked, w_first),
    ]
    runs = _dense.sums(run, at) / np.maximum(np.diff(at), 1)
    return np.hstack([np.stack([*columns, runs], axis=1), _dense.byte_rates(data, at)[:, : FEATURES - len(columns) - 1]]).astype(np.float32)


def _feature_rows(lexicon: tuple[np.ndarray, np.ndarray], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _text.utf8(batch.column("text"))
            for a, b in _text.chunks(data, at):
                x = features(data[at[a] : at[b]], at[a : b + 1] - at[a], lexicon)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.float64)), x.shape[1]).cast(pa.list_(pa.float64()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], rows], [*keep, "features"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7, fit_rows: int = FIT_ROWS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` in [0, 1] and ``predicted``.

    Labels (``doc_id``, ``toxic``) are learned from ids whose CRC-32 modulo ``folds`` isn't ``held_out``; of
    those, ``fit_rows`` at most are used. A score depends on the text alone: equal texts score alike, and null
    and empty texts score as a text without words. Without labels of both kinds every score is
    their share of toxic rows, 0 if there are none. Repeated rows stay; other columns aren't read.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = fold("doc_id", folds) != held_out
    sample = materialize(labelled_sample(labels, "toxic", fit_rows, train), "toxic-sample")
    # bounded by fit_rows
    texts = base.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = materialize(texts.select("doc_id", "text", "label"), "toxic-texts")
    share = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    shown = base.select("doc_id", "text", (~train).alias("held_out"))
    if len(share) < 2:
        constant = 1.0 if share.get(1) else 0.0
        scored = shown.withColumn("score", F.lit(constant))
    else:
        part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10))
        # the lexicon is learned on other rows than the trees, so that its odds mean the same there and in new texts
        lexicon = learn_lexicon(texts.filter(part < 4))
        rest = texts.filter(part >= 4).mapInArrow(_feature_rows(lexicon, ["doc_id", "label"]), "doc_id bigint, label int, features array<double>")
        rest = materialize(rest, "toxic-features").withColumn("features", array_to_vector("features")).withColumn("part", part)
        fit, calibrate = rest.filter("part < 8").withColumn("label", F.col("label").cast("double")), rest.filter("part >= 8")
        if fit.select("label").distinct().count() < 2:
            scored = shown.withColumn("score", F.lit(share[1] / sum(share.values())))
        else:
            trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=7, maxBins=48).fit(fit)
            raised = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
            known = raised(calibrate).select("raw", F.col("label").cast("double").alias("label"))
            steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(known) if known.limit(1).count() else None
            rows = shown.mapInArrow(_feature_rows(lexicon, ["doc_id", "held_out"]), "doc_id bigint, held_out boolean, features array<double>").withColumn("features", array_to_vector("features"))
            scored = raised(rows)
            scored = steps.transform(scored) if steps else scored.withColumn("score", F.col("raw"))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
