"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; unlabelled web text is every row without a label. Features of
all texts are computed once and written. A first positive-against-unlabelled score, trained like the model itself, gives the class
prior: tails of its histogram over all unlabelled rows are compared with those of positives. A small network then minimises the
non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

over all unlabelled rows: slots of about ``SLOT_ROWS`` are trained on side by side against the same positives, and their weights
averaged after every round. With the logistic loss its output is the log-odds of a positive, so no label of a negative is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from . import _dense, _text
from ._labels import fold, labelled_sample
from ._store import materialize

#: Labelled positives used for fitting, at most; a third of them is kept apart for the prior.
FIT_ROWS = 16_000
#: Unlabelled rows in a slot; rounds after which weights are averaged, and passes over a slot in each.
SLOT_ROWS, ROUNDS, EPOCHS = 20_000, 4, 6
HIDDEN = 24

STOP_WORDS = (
    "the of and to in is it that for on with as are this was be by at from or an not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un une du que est pour qui dans sur pas au par "
    "el los las y del se con por para su al lo como más"
).split()
_STOP = np.sort(_text.span_hashes(*(lambda d, at: (d, at[:-1], at[1:]))(*_text.utf8(pa.array(sorted(set(STOP_WORDS)), pa.large_string())))))


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of shape measures per text: marks, capitals, word lengths, repetition of words, lines and
    windows, stop words and length. All are 0 for an empty text."""
    n = len(at) - 1
    starts, ends, first = _text.words(data, at)
    count = np.diff(first)
    words = np.maximum(count, 1)
    lengths = (ends - starts).astype(np.float64)
    lower = _text.LOWER[data]
    hashes = _text.span_hashes(lower, starts, ends)
    place = np.minimum(np.searchsorted(_STOP, hashes), len(_STOP) - 1)
    stop = _STOP[place] == hashes
    letters = np.concatenate([[0], np.cumsum(_dense.LETTER[data])])
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    w_letters, w_upper = letters[ends] - letters[starts], upper[ends] - upper[starts]
    mean = _dense.sums(lengths, first) / words
    square = _dense.sums(lengths**2, first) / words
    longest = np.zeros(n)
    np.maximum.at(longest, np.repeat(np.arange(n), count), lengths)
    # lines: what stands between newlines, hashed by its words
    line_start = np.zeros(len(starts), bool)
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    line_start[1:] = newline[starts[1:]] != newline[starts[:-1]]
    line_start[first[:-1][count > 0]] = True
    line_first = np.flatnonzero(line_start)
    if len(line_first):
        line_place = np.arange(len(starts)) - np.repeat(line_first, np.diff(np.append(line_first, len(starts))))
        line_hash = np.add.reduceat(_text.mix(hashes + line_place.astype(np.uint64)), line_first)
    else:
        line_hash = np.empty(0, np.uint64)
    lines = np.searchsorted(line_first, first)
    window, window_first = _dense.windows(hashes, first)
    columns = [
        np.log1p(count),
        np.minimum(mean, 50),
        np.sqrt(np.minimum(np.maximum(square - mean**2, 0), 2500)),
        np.log1p(longest),
        _dense.sums(stop, first) / words,
        _dense.sums((w_upper == w_letters) & (w_letters > 1), first) / words,
        _dense.sums(w_letters < ends - starts, first) / words,
        _dense.sums(w_letters == 0, first) / words,
        _dense.repeat_rates(hashes, first),
        _dense.repeat_rates(line_hash, lines),
        _dense.repeat_rates(window, window_first),
        np.log1p(np.diff(lines)),
        np.diff(lines) / words,
    ]
    return np.hstack([np.stack(columns, axis=1), np.sqrt(_dense.byte_rates(data, at))]).astype(np.float32)


def text_features(column: pa.Array) -> np.ndarray:
    data, at = _text.utf8(column)
    parts = [features(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in _text.chunks(data, at)]
    return np.vstack(parts) if parts else np.empty((0, 0), np.float32)


Weights = list[np.ndarray]


def start_network(inputs: int, hidden: int = HIDDEN, seed: int = 11) -> Weights:
    """One hidden layer of tanh units."""
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 1 / np.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]


def output(w: Weights, x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3][0]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def risk_slopes(zp: np.ndarray, zu: np.ndarray, prior: float | None) -> np.ndarray:
    """d(risk)/d(output) of positives, then of unlabelled rows, for the logistic loss.

    Without a prior the risk is that of plain positives against unlabelled rows. Where the unbiased risk of negatives is below 0,
    the step goes back on that part alone."""
    if prior is None:
        return np.concatenate([-(1 - sigmoid(zp)) / len(zp), sigmoid(zu) / len(zu)])
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    down = np.concatenate([-prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)])
    if negative < 0:
        return -down
    return down + np.concatenate([-prior * (1 - sigmoid(zp)) / len(zp), np.zeros(len(zu))])


def descend(w: Weights, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int, rate: float, seed: int = 0) -> Weights:
    """Adam on mini-batches of both."""
    w, rng = [x.copy() for x in w], np.random.default_rng(seed)
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    batches = max(1, (len(positive) + len(unlabelled)) // 512)
    for _ in range(epochs):
        p_order, u_order = (np.array_split(rng.permutation(len(x)), batches) for x in (positive, unlabelled))
        for p_rows, u_rows in zip(p_order, u_order, strict=True):
            if not len(p_rows) or not len(u_rows):
                continue
            x = np.vstack([positive[p_rows], unlabelled[u_rows]])
            h = np.tanh(x @ w[0] + w[1])
            z = h @ w[2] + w[3][0]
            slope = risk_slopes(z[: len(p_rows)], z[len(p_rows) :], prior)
            back = slope[:, None] * w[2] * (1 - h * h)
            t += 1
            for k, g in enumerate([x.T @ back + 1e-4 * w[0], back.sum(0), h.T @ slope, np.array([slope.sum()])]):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, cuts: np.ndarray, u_counts: np.ndarray) -> float:
    """The share of positives in unlabelled rows: the least ratio of the two tails above a score.

    ``u_counts[k]`` is the number of unlabelled rows with exactly ``k`` of the ascending ``cuts`` at or below their score.
    Any share of unlabelled rows above a score is at least prior times that of positives, so each ratio
    bounds the prior from above; a margin for the tails' sampling error is added before taking the least.
    """
    p_tail = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    total = u_counts.sum()
    u_tail = 1 - np.cumsum(u_counts)[: len(cuts)] / total
    margin = np.sqrt(np.log(20) / (2 * total)) + np.sqrt(np.log(20) / (2 * len(positive)))
    best = int(np.argmin((u_tail + margin) / np.maximum(p_tail, 1e-9)))
    return float(np.clip(u_tail[best] / max(p_tail[best], 1e-9), 0.05, 0.98))


class QualityModel:
    """Standardised features and the network's log-odds; without enough rows to fit, one constant score."""

    def __init__(self, constant: float | None, mean: np.ndarray | None = None, scale: np.ndarray | None = None, weights: Weights | None = None, prior: float = 0.5):
        self.constant, self.mean, self.scale, self.weights, self.prior = constant, mean, scale, weights, prior

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(output(self.weights, self.standard(x)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Feature vectors as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = text_features(batch.column("text"))
        width = x.shape[1]
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * width, pa.int32()), pa.array(x.ravel(), pa.float32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows], [*batch.schema.names[:-1], "features"])


def with_features(texts: DataFrame) -> DataFrame:
    """The columns before ``text``, the last one, and the text's features; written, as several passes read them."""
    schema = StructType([*texts.schema.fields[:-1], StructField("features", ArrayType(FloatType()))])
    return materialize(texts.mapInArrow(_with_features, schema), "quality-features")


def _train_slot(model: QualityModel, positive: np.ndarray, prior: float | None, number: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        # in the order of hashes, so that the layout of the input doesn't matter
        x = model.standard(matrix(table.sort_by("hash").column("features")))
        fitted = descend(model.weights, positive, x, prior, EPOCHS, 0.01 / (1 + number), seed=number)
        flat = np.concatenate([w.ravel() for w in fitted])
        return pa.table([pa.array([0], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([(flat * len(x)).tolist()], pa.list_(pa.float64()))], ["one", "size", "sums"])

    return run


def train(model: QualityModel, positive: np.ndarray, unlabelled: DataFrame, prior: float | None, rounds: int = ROUNDS) -> Weights:
    """Weights averaged over the slots of ``(slot, hash, features)`` after every round; sums are taken in Spark."""
    weights = start_network(positive.shape[1])
    for number in range(rounds):
        current = QualityModel(None, model.mean, model.scale, weights)
        trained = unlabelled.groupBy("slot").applyInArrow(_train_slot(current, positive, prior, number), "one int, size bigint, sums array<double>")
        parts = trained.select("size", F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("size").alias("size")).orderBy("at").collect()
        flat = np.array([r["x"] / r["size"] for r in parts])
        weights = [x.reshape(w.shape) for x, w in zip(np.split(flat, np.cumsum([w.size for w in weights])[:-1]), weights, strict=True)]
    return weights


def _histogram(model: QualityModel, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            if len(batch):
                z = output(model.weights, model.standard(matrix(batch.column("features"))))
                counts += np.bincount(np.searchsorted(cuts, z, "right"), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts)], ["at", "n"])

    return run


def fit_quality_model(feats: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, fit_rows: int = FIT_ROWS) -> QualityModel:
    """The model from rows ``(doc_id, features)`` of the training folds alone.

    ``fit_rows`` bounds the labelled positives. All unlabelled rows count: in the features' mean and spread, in the prior, and in the
    risk. Repeats of a row count each; a null id is in no fold."""
    train_rows = feats.filter("doc_id IS NOT NULL").filter(fold("doc_id", folds) != held_out).select("doc_id", "features")
    known = materialize(labelled_sample(labels.filter("quality = 1"), "quality", fit_rows, fold("doc_id", folds) != held_out), "quality-sample")
    # bounded by fit_rows
    rows = train_rows.join(F.broadcast(known.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features")).orderBy("doc_id").collect()
    positive = np.array([r["features"] for r in rows], np.float64)
    unlabelled = train_rows.join(labels.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_anti")
    stats = unlabelled.select(F.posexplode("features").alias("at", "x")).groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale")).orderBy("at").collect()
    n = stats[0]["n"] if stats else 0
    if len(positive) < 10 or n < 10:
        share = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(fold("doc_id", folds) != held_out).agg(F.avg("quality")).first()[0]
        return QualityModel(0.5 if share is None else float(share))
    model = QualityModel(None, np.array([r["mean"] for r in stats]), np.array([r["scale"] for r in stats]) + 1e-3)
    own = F.xxhash64("doc_id", F.lit("slot"))
    slotted = unlabelled.select(F.pmod(own, F.lit(max(1, n // SLOT_ROWS))).alias("slot"), own.alias("hash"), "features")
    slotted = materialize(slotted, "quality-unlabelled")

    x = model.standard(positive)
    apart = np.arange(len(x)) % 3 == 0
    model.weights = train(model, x[~apart], slotted, None, rounds=1)
    z = output(model.weights, x[apart])
    cuts = np.unique(np.quantile(z, np.linspace(0.02, 0.9, 45)))
    counts = np.zeros(len(cuts) + 1)
    for r in slotted.mapInArrow(_histogram(model, cuts), "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    model.prior = estimate_prior(z, cuts, counts)
    model.weights = train(model, x, slotted, model.prior)
    return model


def _scores(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("features"))
            score = model.score(x) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` in [0, 1] and ``predicted``.

    A score depends on the text alone; null and empty texts score alike. Without ten positives and ten
    unlabelled rows the score is the labelled share of positives (0.5 without labels). Repeated rows
    stay; other columns aren't read. An empty table gives an empty table.
    """
    feats = with_features(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    model = fit_quality_model(feats, labels, folds, held_out, fit_rows)
    shown = feats.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "features")
    scored = shown.mapInArrow(_scores(model), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The input's rows whose text scores ``threshold`` or more; all its columns pass through, whatever their names.

    Rows without an id are scored too. An empty table gives an empty table."""
    # the input's row is one column, so that no name in it can clash
    feats = with_features(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    model = fit_quality_model(feats.select("doc_id", "features"), labels, **options)
    shown = feats.select("row", "features")
    scored = shown.mapInArrow(_scores(model), StructType([shown.schema["row"], StructField("score", DoubleType())]))
    return scored.filter(F.col("score") >= threshold).select("row.*")
