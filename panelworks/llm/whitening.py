"""Whitening of embeddings: an incremental eigendecomposition refined by a distributed Rayleigh-Ritz step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelworks.llm.folding import PARTIAL, fold_tree
from panelworks.llm.secular import Spectrum

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Components whose share of the variance is below this have no direction and are left out.
LEAST = 1e-13
#: Larger entries have no exact integer and count as not finite.
MOST = 2.0**61 / SCALE
_HALF = 26
_ROWS = 4096


def fixed_points(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids' places in the batch and the integer vectors of the rows that count."""
    column = batch.column(1)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    place = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(place)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(place), size)
    fits = (np.abs(flat) <= MOST).all(axis=1)
    return place[fits], np.floor(flat[fits] * SCALE).astype(np.int64) + SHIFT


@dataclass
class Fit:
    """What whitening needs, a few vectors of the dimension and its square: counts, sums, eigenpairs."""

    count: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def away(self, points: np.ndarray) -> np.ndarray:
        """The exact ``n x - S``, as Python integers where 64 bits can't hold them."""
        if self.sums.dtype == object or (len(points) and int(np.abs(points).max()) * self.count >= 1 << 62):
            return points.astype(object) * self.count - self.sums
        return points * self.count - self.sums

    def centred(self, points: np.ndarray) -> np.ndarray:
        return (self.away(points) / self.count).astype(np.float64)

    def deviations(self, points: np.ndarray) -> list[int]:
        """The exact sums of ``(n x - S) ** 2``."""
        away = self.away(points)
        if len(away) and int(np.abs(away).max()) ** 2 * away.shape[1] >= 1 << 63:
            away = away.astype(object)
        return (away * away).sum(axis=1).tolist()


def _lot() -> int:
    return TaskContext.get().partitionId()


def _row(states: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(states), pa.int64()),
            pa.array([_lot()] * len(states), pa.int64()),
            pa.array(list(states.values()), pa.binary()),
        ],
        ["key", "lot", "state"],
    )


def _sum_of(kind: type) -> Callable[[Iterator[bytes]], bytes]:
    def combine(states: Iterator[bytes]) -> bytes:
        return sum(np.frombuffer(state, kind) for state in states).tobytes()

    return combine


def _summed(rows: DataFrame, size: int, of_points: Callable[[np.ndarray], np.ndarray], label: str) -> np.ndarray | None:
    """The sum over all vectors of what ``of_points`` adds up for some of them, by a tree over the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            points = fixed_points(batch, size)[1]
            for at in range(0, len(points), _ROWS):
                part = of_points(points[at : at + _ROWS])
                total = part if total is None else total + part
        if total is not None:
            yield _row({0: np.ascontiguousarray(total).tobytes()})

    sample = of_points(np.zeros((1, size), np.int64))
    folded = fold_tree(rows.mapInArrow(add, PARTIAL), _sum_of(sample.dtype.type), label).first()
    return None if folded is None else np.frombuffer(folded["state"], sample.dtype).reshape(sample.shape)


def _dimension(rows: DataFrame) -> int:
    """The most frequent length of a vector, of equally frequent ones the larger."""
    lengths = rows.groupBy(F.size("vector").alias("size")).count().where("size > 0")
    most = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    return most["size"] if most else 0


def _spectrum(rows: DataFrame, size: int) -> Spectrum:
    """Each task adds its vectors one by one (equal ones of a batch at once); the tree merges the spectra."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum.empty(size)
        for batch in batches:
            points, times = np.unique(fixed_points(batch, size)[1], axis=0, return_counts=True)
            for point, many in zip(points.astype(np.float64), times):
                spectrum.add(point, int(many))
        if spectrum.count:
            yield _row({0: spectrum.to_bytes()})

    def merge(states: Iterator[bytes]) -> bytes:
        whole = Spectrum.empty(size)
        for state in states:
            whole.merge(Spectrum.from_bytes(state, size))
        return whole.to_bytes()

    folded = fold_tree(rows.mapInArrow(gather, PARTIAL), merge, "whiten-spectra").first()
    return Spectrum.from_bytes(folded["state"], size) if folded else Spectrum.empty(size)


def _count_and_sums(rows: DataFrame, size: int) -> tuple[int, np.ndarray]:
    def halves(points: np.ndarray) -> np.ndarray:
        return np.vstack(((points >> _HALF).sum(axis=0), (points & ((1 << _HALF) - 1)).sum(axis=0), np.full(size, len(points))))

    high, low, count = _summed(rows, size, halves, "whiten-sums").tolist()
    sums = [(h << _HALF) + v for h, v in zip(high, low)]
    return count[0], np.array(sums, np.int64 if max(map(abs, sums)) < 1 << 62 else object)


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Fit, float] | None:
    """The eigenpairs of the covariance of all ``vector`` that count, and the identity error of their whitening.

    The tasks' incremental spectra give a basis; the covariance is then taken in this basis over all vectors (centred by
    exact sums) and its small eigenproblem rotates the basis. What the driver holds is of the size of that matrix.
    """
    size = _dimension(rows)
    spectrum = _spectrum(rows, size) if size else Spectrum.empty(0)
    if not spectrum.count:
        return None
    count, sums = _count_and_sums(rows, size)
    basis = np.linalg.qr(spectrum.vectors)[0]
    rough = Fit(count, sums, spectrum.values, basis, 0.0)

    def projected(points: np.ndarray) -> np.ndarray:
        y = rough.centred(points) @ basis
        return y.T @ y

    ritz = _summed(rows, size, projected, "whiten-ritz") / count
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-values)[:components]
    trace = float(values.sum())
    order = order[values[order] > LEAST * trace]
    final = Fit(count, sums, values[order], basis @ turn[:, order], trace)
    unit = final.vectors / np.sqrt(final.values)

    def moments(points: np.ndarray) -> np.ndarray:
        y = final.centred(points) @ unit
        return np.vstack((y.T @ y, y.sum(axis=0)))

    if not len(order):
        return final, 0.0
    total = _summed(rows, size, moments, "whiten-error") / count
    error = total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(order))
    return final, float(np.abs(error).max())


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``: a row per vector, the components as arrays.

    Vectors that are null, empty or hold null, NaN, infinite or huge (above MOST) entries are left out, and so are those
    of another length than the most frequent one. Every other row, repeated ones too, is fitted and returned, with a
    null id as well. ``whitened`` and ``explained`` go by falling eigenvalue; directions without variance (a share below
    LEAST) have no component, so equal vectors give empty arrays. ``deviation`` is null where a long can't hold it. An
    empty table gives none. Every pass reads the table again; no pass shuffles vectors.
    """
    rows = embeddings.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    schema = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    kind = rows.schema["vec_id"].dataType.simpleString()
    found = fit(rows, components)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {schema}")
    final, error = found
    unit = final.vectors / np.sqrt(final.values)
    share = final.values / final.trace if len(final.values) else final.values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, points = fixed_points(batch, len(final.sums))
            ids = batch.column(0).take(pa.array(place))
            for at in range(0, len(points), _ROWS):
                some = points[at : at + _ROWS]
                y = final.centred(some) @ unit
                offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                shares = pa.array(np.tile(share, len(y)), pa.float64())
                exact = [v if v < 1 << 63 else None for v in final.deviations(some)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[at : at + _ROWS],
                        pa.array(np.full(len(y), final.count)),
                        pa.array(exact, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(y.ravel())),
                        pa.ListArray.from_arrays(offsets, shares),
                        pa.array(np.full(len(y), error)),
                    ],
                    ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, f"vec_id {kind}, {schema}")


def components_of(whitened: DataFrame) -> DataFrame:
    """A row per vector and component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "pair")
    return whitened.select("vec_id", "n", "deviation", "identity_error", pairs).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"),
        "identity_error",
    )
