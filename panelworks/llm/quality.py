"""Document quality by Bradley-Terry ranking of labelled pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelworks.llm.language import held_out
from panelworks.llm.staging import stored
from panelworks.llm.words import hashes, slices, words

#: Places of the scale on which scores of good and bad rows meet; a row counts for the two places beside its score.
BINS = 2048
RIDGE, STEPS, CLOSE = 1e-3, 50, 1e-7
#: Scores that are brought to the driver to pick one by rank; more are narrowed down by counts first.
PICKED = 10_000
#: The score that stands for the threshold.
CUT = 0.7
_UPPER, _LOWER, _DIGIT, _STOP, _SYMBOL, _SPACE = range(6)
_CLASS = np.full(256, _LOWER, dtype=np.int64)
_CLASS[:128] = _SYMBOL
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LOWER
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = _STOP
FEATURES = 14


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text, all taken over the whole text."""
    n = len(offsets) - 1
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(text_of * 6 + _CLASS[data], minlength=n * 6).reshape(n, 6).astype(float)
    begins, ends, owner = words(data, offsets)
    hashed = hashes(data, begins, ends)
    count = np.bincount(owner, minlength=n).astype(float)
    same = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    adjacent = np.bincount(owner[1:][same], minlength=n)
    order = np.lexsort((hashed, owner))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    shouted = np.bincount(owner, np.where(_CLASS[data[begins]] == _UPPER, 1.0, 0.0), minlength=n) if len(begins) else np.zeros(n)
    bytes_, letters = np.maximum(np.diff(offsets), 1), np.maximum(kinds[:, _UPPER] + kinds[:, _LOWER], 1)
    at_least = np.maximum(count, 1)
    shares = np.stack(
        [
            kinds[:, _UPPER] / letters,
            kinds[:, _DIGIT] / bytes_,
            kinds[:, _STOP] / bytes_,
            kinds[:, _SYMBOL] / bytes_,
            adjacent / at_least,
            shouted / at_least,
        ]
    )
    logs = np.log(shares + 0.002)
    repeated = np.log1p(count) * (1 - distinct / at_least)
    out = np.concatenate([shares, logs, [repeated, np.log1p(count)]])
    return out.T


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (the last column is the text) with the text replaced by its ``features``."""
    names = rows.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_features(data, offsets) for _, data, offsets in slices(batch.column(len(names)))]
            values = np.concatenate(made) if made else np.zeros((0, FEATURES))
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(values) + 1) * FEATURES, pa.int32()), pa.array(values.ravel())
            )
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], flat], [*names, "features"])

    return rows.mapInArrow(run, f"{schema}, features array<double>")


class _Scale:
    """BINS equal places that hold every score ``features @ weights`` of features between ``low`` and ``high``."""

    def __init__(self, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        ends = weights * low, weights * high
        self.weights, self.begin = weights, float(np.minimum(*ends).sum())
        self.step = max((float(np.maximum(*ends).sum()) - self.begin) / (BINS - 1), 1e-9)

    def places(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place below each score, and the share of the row that counts for the one above."""
        at = np.clip((features @ self.weights - self.begin) / self.step, 0, BINS - 1)
        below = np.minimum(at.astype(np.int64), BINS - 2)
        return below, at - below

    def sums(self, features: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Rows and sums of their features at each place, bad rows first."""
        below, share = self.places(features)
        at = labels * BINS + below
        out = np.zeros((2 * BINS, features.shape[1] + 1))
        for i, values in enumerate((np.ones(len(at)), *features.T)):
            for where, part in ((at, 1 - share), (at + 1, share)):
                out[:, i] += np.bincount(where, values * part, minlength=2 * BINS)
        return out

    def products(self, features: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sum of each row's feature products, weighted by what ``weight`` gives its class and score."""
        below, share = self.places(features)
        at = labels * BINS + below
        return (features * (weight[at] * (1 - share) + weight[at + 1] * share)[:, None]).T @ features


def _ranking(sums, products, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Weights of the Bradley-Terry model over all pairs of a good and a bad row, by Newton steps on the ridge logistic loss.

    ``sums(scale)`` and ``products(scale, weight)`` add up :class:`_Scale` over all rows. A pair enters by the places of
    its two scores, so a step takes two passes over the rows and not one over their pairs.
    """
    weights = np.zeros(len(low))
    apart = np.arange(BINS)[:, None] - np.arange(BINS)[None, :]
    for _ in range(STEPS):
        scale = _Scale(weights, low, high)
        bad, good = sums(scale).reshape(2, BINS, -1)
        pairs = bad[:, 0].sum() * good[:, 0].sum()
        # By place of the good row and of the bad one: how likely the model takes the bad one for the better.
        lost = 1 / (1 + np.exp(np.clip(apart * scale.step, -500, 500)))
        slope = ((lost @ bad[:, 0]) @ good[:, 1:] - (good[:, 0] @ lost) @ bad[:, 1:]) / pairs - RIDGE * weights
        lost *= 1 - lost
        both = good[:, 1:].T @ lost @ bad[:, 1:]
        own = products(scale, np.concatenate((good[:, 0] @ lost, lost @ bad[:, 0])) / pairs)
        step = np.linalg.solve(own - (both + both.T) / pairs + RIDGE * np.eye(len(weights)), slope)
        weights = weights + step
        if np.abs(step).max() < CLOSE:
            break
    # Sums in another order differ in digits far behind these.
    return np.round(weights, 5)


def fit(features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """What :func:`fit_rows` gives for rows in memory."""
    bad = int((labels == 0).sum())
    if not bad or bad == len(labels):
        return np.zeros(features.shape[1]), 0.0
    scale = np.maximum(features.std(axis=0), 1e-9)
    z = features / scale
    weights = _ranking(lambda s: s.sums(z, labels), lambda s, w: s.products(z, labels, w), z.min(axis=0), z.max(axis=0)) / scale
    return weights, float(np.quantile(features @ weights, bad / len(labels), method="midpoint"))


def _total(weights: np.ndarray) -> Column:
    return sum((F.col("features")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))


def fit_rows(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and threshold from all ``rows`` (``features``, ``label`` 0 or 1) and all pairs of a good and a bad one:
    P(good before bad) is the logistic of the score difference.

    The threshold is the exact quantile of the scores at the share of bad rows. Without both labels the weights are
    zero. Only sums by place, BINS a class, come to the driver.
    """
    each = [F.col("features")[i] for i in range(FEATURES)]
    aggregates = [f(c) for f in (F.stddev_pop, F.min, F.max) for c in each]
    bad, n, *found = rows.agg(F.count_if(F.col("label") == 0), F.count("*"), *aggregates).first()
    if not bad or bad == n:
        return np.zeros(FEATURES), 0.0
    spread, low, high = np.array(found, dtype=float).reshape(3, -1)
    # To few digits: sums in another order give the same.
    scale = np.array([float(f"{max(x, 1e-9):.6g}") for x in spread])

    def added(of, shape: tuple[int, int]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                total += of(flat.reshape(-1, FEATURES) / scale, batch.column(1).to_numpy().astype(np.int64))
            at = np.flatnonzero(total.any(axis=1))
            columns = [pa.array(at, pa.int32()), *(pa.array(c) for c in total[at].T)]
            yield pa.RecordBatch.from_arrays(columns, ["at", *(f"c{i}" for i in range(shape[1]))])

        names = [f"c{i}" for i in range(shape[1])]
        made = rows.select("features", "label").mapInArrow(run, "at int, " + ", ".join(f"{c} double" for c in names))
        out = np.zeros(shape)
        for row in made.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect():
            out[row["at"]] = row[1:]
        return out

    weights = _ranking(
        lambda s: added(s.sums, (2 * BINS, FEATURES + 1)),
        lambda s, w: added(lambda x, y: s.products(x, y, w), (FEATURES, FEATURES)),
        low / scale,
        high / scale,
    )
    weights = weights / scale
    scores = rows.select(_total(weights).alias("score"))
    place, between = divmod((n - 1) * bad, n)
    value = _ranked(scores, place)
    return weights, (value + _ranked(scores, place + 1)) / 2 if between else value


def _ranked(scores: DataFrame, rank: int) -> float:
    """The score of this rank, from 0 on: counts over BINS equal ranges narrow down where it is."""
    low, high, n = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
    while n > PICKED and low < high:
        within = scores.where(F.col("score").between(low, high))
        at = F.least(F.floor((F.col("score") - low) / (high - low) * BINS), F.lit(BINS - 1))
        counted = within.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for row in counted.orderBy("at").collect():
            if rank < row["n"]:
                low, high, n = row["low"], row["high"], row["n"]
                break
            rank -= row["n"]
    if low == high:
        return low
    return sorted(row["score"] for row in scores.where(F.col("score").between(low, high)).collect())[rank]


def score_quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Features of the whole text are computed once for all rows. The ranking is learned on all labelled rows that are not
    held out. ``score`` is the logistic of the distance to the threshold,
    shifted so that the threshold is 0.7. Null texts score as empty ones; repeated rows score alike; labels other than
    0 and 1 and rows without a label are not learned from; with one label only every score is 0.7. An empty table gives
    no rows.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column))
    known = stored(with_features(rows), "quality-features")
    marks = labels.where(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
    learned = known.where("NOT held_out").join(marks, F.col("doc_id") == F.col("id"))
    learned = stored(learned.select("features", F.col("label").cast("int").alias("label")), "quality-learned")
    weights, threshold = fit_rows(learned)
    total = _total(weights)
    shift = float(np.log(CUT / (1 - CUT)))
    away = F.greatest(F.least(total - threshold, F.lit(500.0)), F.lit(-500.0))
    # Rounded, so that the threshold itself scores CUT and not a hair less.
    scored = known.select("doc_id", "held_out", F.round(1 / (1 + F.exp(-(away + shift))), 12).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
