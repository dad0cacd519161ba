"""Embedding whitening: principal components of integer vectors, scaled to unit variance.

Method.  Vectors become integers; the fit list holds each distinct one once.  A first pass over it adds them up exactly, which gives the
mean; a second adds the outer products of centred vectors, one NumPy matrix product a batch; partial matrices are merged by ``treeAggregate``.
LAPACK's symmetric ``eigh`` gives the components on the driver, and the projection is broadcast and applied to every row.
A third pass over the fit list takes the covariance of the whitened vectors, for ``identity_error``.

Scale.  The only shuffle is that of the distinct vectors, pre-aggregated, so copies are dropped where they lie.  The fit list is a table of the shared
folder, read once a pass.  A task holds one batch and one d x d matrix; the driver gets about the square root of the number of partitions of them.
What is broadcast is d * (components + 1) doubles.

Edge cases.  Rows whose vector is null, or holds null or non-finite entries, are dropped.  Shorter vectors read as padded with zeros
to the longest; if all are empty there are no components and no rows.  Entries and deviations beyond the range of long take its ends; sums stay exact.
A component without variance (up to rounding) is returned with null ``whitened``, ``explained`` is null where no vector differs from another.
Repeated rows and ids are all kept, a null id too; other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SCALE, COMPONENTS = 256, 4
_TOP = (1 << 63) - 1
Part = TypeVar("Part")


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def finite(vector: Column) -> Column:
    """Whether there is a vector and all of its entries are finite."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def padded(vector: Column, width: int) -> Column:
    return F.when(F.size(vector) == width, vector).otherwise(F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(width) - F.size(vector), F.lit(0)))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def over(table: DataFrame, width: int, each: Callable[[np.ndarray], Part], merge: Callable[[Part, Part], Part]) -> Part | None:
    """``each`` of every batch of x vectors, merged in tasks and then by ``treeAggregate``; None for an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            if len(batch):
                new = each(matrix(batch.column(0), width))
                part = new if part is None else merge(part, new)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part)], pa.binary())], ["part"])

    both = lambda a, b: merge(a, b) if a is not None and b is not None else b if a is None else a
    return shared.bounded(table).select("x").mapInArrow(run, "part binary").rdd.treeAggregate(None, lambda a, row: both(a, pickle.loads(row[0])), both)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums over rows as Python integers."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return (x if top * len(x) <= _TOP else x.astype(object)).sum(0).astype(object)


def counted(x: np.ndarray) -> tuple[int, np.ndarray]:
    return len(x), exact_sum(x)


def moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and centred products."""
    mean = w.mean(0)
    return len(w), mean, (w - mean).T @ (w - mean)


def joined(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """The moments of both lists together, still centred before multiplying."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


@dataclass(frozen=True)
class Whitening:
    """``count`` distinct vectors, their exact sums, the projection (one column a component with variance) and the shares of the variance."""

    count: int
    sums: list[int]
    mean: np.ndarray
    projection: np.ndarray
    explained: list[float | None]
    identity_error: float | None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n x - S)^2, exact up to the largest long."""
        sums = np.array(self.sums, object)
        top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.count + max(map(abs, self.sums), default=0)
        if top > _TOP:
            return np.array([min(int(v), _TOP) for v in ((x.astype(object) * self.count - sums) ** 2).sum(1)], np.int64)
        apart = x * np.int64(self.count) - sums.astype(np.int64)
        near = np.square(apart.astype(float)).sum(1)
        with np.errstate(over="ignore"):
            exact = np.square(apart.view(np.uint64)).sum(1)  # exact below 2^64, where the squares' low halves tell all
        return np.where(near > 9.3e18, np.uint64(_TOP), np.minimum(exact, np.uint64(_TOP))).astype(np.int64)


def _add(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def fit(table: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Learned from ``x`` of the table, vectors of the same width; None without rows."""
    if (found := over(table, width, counted, _add)) is None:
        return None
    n, sums = found
    mean = np.array([int(s) / n for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = over(table, width, products, np.add) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    shown = min(components, width)
    live = int((values[:shown] > trace * width * np.finfo(float).eps).sum())
    vectors = vectors[:, :live] * np.where(vectors[np.abs(vectors[:, :live]).argmax(0), np.arange(live)] < 0, -1.0, 1.0)
    model = Whitening(n, [int(s) for s in sums], mean, vectors / np.sqrt(values[:live]), [float(max(v, 0.0)) / trace if trace > 0 else None for v in values[:shown]], None)
    if not live:
        return model
    _, _, products_of_whitened = over(table, width, lambda x: moments(model.whiten(x)), joined)
    error = float(np.abs(products_of_whitened / n - np.eye(live)).max())
    return Whitening(model.count, model.sums, model.mean, model.projection, model.explained, error)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error for every row with a finite vector and every component."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.where(finite(F.col(vector))).select(F.col(key).alias("key"), integers(F.col(vector), scale).alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    rows = rows.select("key", padded(F.col("x"), width or 0).alias("x"))
    table, path = shared.written(rows.select("x").distinct(), "vectors")
    model = fit(table, width, components) if width else None
    shared.drop(spark, path)
    if model is None:
        return spark.createDataFrame([], shape)
    sent, shown = spark.sparkContext.broadcast(model), len(model.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            x = matrix(batch.column(1), width)
            m = len(x)
            white = np.full((m, shown), np.nan)
            white[:, : model.projection.shape[1]] = model.whiten(x)
            explained = pa.array(model.explained, pa.float64())
            again = pa.array(np.repeat(np.arange(m), shown))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again), pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), m)), pa.array(np.full(m * shown, model.count)), pa.array(model.deviation(x)).take(again),
                    pa.array(white.ravel(), from_pandas=True), explained.take(pa.array(np.tile(np.arange(shown), m))), pa.array([model.identity_error], pa.float64()).take(pa.array(np.zeros(m * shown, np.int64))),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, shape)
