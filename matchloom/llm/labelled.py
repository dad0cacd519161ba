"""A bounded, repeatable sample of labelled rows for fitting on the driver.

Rows are chosen by a hash of their id and text, so the sample is the same however the
tables are partitioned, ids that repeat with other texts are as many rows, and it costs one pass to size
it.  ``bound`` limits the rows and ``byte_bound`` the text that reach the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 30


def fold(column: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(column.cast("string")) % n, F.lit(-1))


def folds_of(ids: pa.Array, n: int) -> list[int]:
    """The same on the Arrow side."""
    return [-1 if x is None else zlib.crc32(str(x).encode()) % n for x in ids.to_pylist()]


def sample(documents: DataFrame, strata: DataFrame, stratum: str, bound: int, byte_bound: int) -> pa.Table:
    """About ``bound`` rows of (doc_id, text, stratum) at most for each stratum value.

    ``strata`` has doc_id and stratum.  Rows with a null stratum, id or text are left out.
    A stratum with fewer rows is taken whole; equal rows count once.  Of a larger one, rows are taken by a hash up to
    the share that keeps the rows near ``bound`` and their texts near ``byte_bound`` bytes; texts are
    never cut.  Only ids, hashes and lengths are shuffled; those of the rows chosen, whose number is bounded, are
    broadcast to fetch the texts.
    """
    texts = documents.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(17)).alias("_key")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    strata = strata.select("doc_id", stratum).where(F.col(stratum).isNotNull()).distinct()
    narrow = texts.select("doc_id", "_key", F.octet_length("text").alias("_size")).join(strata, "doc_id").distinct()
    facts = narrow.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).collect()
    keep = F.lit(False)
    for value, n, size in facts:
        share = min(1.0, bound / n, byte_bound / max(1, size))
        keep |= (F.col(stratum) == F.lit(value)) & (F.pmod("_key", F.lit(_SPACE)) < F.lit(int(share * _SPACE) + 1))
    chosen = narrow.where(keep).select("doc_id", "_key", stratum).toArrow()
    if not len(chosen):
        return chosen.drop_columns(["_key"]).add_column(1, "text", pa.array([], pa.string()))
    ids = documents.sparkSession.createDataFrame(chosen, narrow.select("doc_id", "_key", stratum).schema)
    taken = texts.join(F.broadcast(ids), ["doc_id", "_key"]).dropDuplicates(["doc_id", "_key", stratum]).select("doc_id", "text", stratum, F.pmod("_key", F.lit(_SPACE)).alias("_at")).toArrow()
    return taken.sort_by([("_at", "ascending"), ("doc_id", "ascending"), ("text", "ascending"), (stratum, "ascending")]).drop_columns(["_at"])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve that turns margins into probabilities: Platt's targets, Newton's steps halved until they help, never falling."""
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(1e-9, float(np.std(x)))
    z = np.stack([x / scale, np.ones(len(x))], 1)

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - goal * m).sum()) + 5e-4 * float(w[0] ** 2)

    w = np.array([1.0, float(np.log((up + 1) / (down + 1)))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        slope = z.T @ (p - goal) + np.array([1e-3 * w[0], 0])
        step = np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-3 * np.eye(2), slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(w[0]) / scale, 1e-3), float(w[1])
