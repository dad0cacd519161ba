"""Exact top-k search by integer inner product, with MaxScore pruning.

Method.  Vectors are packed into shards, queries into blocks; every block meets every shard once.
A query's terms are its dimensions.  A shard is cut into lists of rows that are alike (by their strongest dimension and its sign), and each
list has for each term the most that it can add to a score.  With the k-th best score so far as threshold (for the first shard, the k-th best of the list
that promises a query most),
a list whose bounds in all stay below it is passed over.  In the others the terms with the smallest bounds, as
many as cannot reach the threshold together, are non-essential: only the essential terms are traversed (one matrix product of the
queries that share them), and rows whose partial score and the bound of the rest stay below the threshold are dropped.
The others are probed in the remaining terms, a few at a time, while they are competitive.  Where no terms can be spared the traversal is the
plain product.  A shard gives at most k rows a query (all ties counted, then the smaller ids), and shards are merged by rank.

Scale.  The query set (one row in ``EVERY``) meets all rows in blocks.  Shards are dealt evenly to buckets; a task holds the shards of one
bucket, ``LEAST_HELD`` to about ``HELD``, and the query blocks stream past them, so what moves is vectors + queries * buckets.
Nothing is broadcast.

Edge cases.  Vectors that are null or hold null or non-finite components, and rows with a null id,
take no part.  Shorter vectors read as padded with zeros; an empty vector scores 0.  Rows with the id of the query
are its own and no candidates; other repeated ids each count.  Query rows that share an id share one list: the best pairs of any of them with a candidate.  Sums that doubles cannot hold exactly are made in
Python integers and clipped to the range of long.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import with_row_number
from . import shared

TOP, EVERY, SCALE = 20, 20, 64
SHARD_ROWS, BLOCK_ROWS = 8192, 512
#: Shards (4 MB each at 64 dimensions) that a task holds, and rows of a list.
HELD, LIST_ROWS = 32, 512
#: Shards that a task holds at least, where there are so many, so that thresholds of the first serve the others.
LEAST_HELD = 4
#: Terms probed at a time, and the share of the terms that must be spared to be worth it.
STEP, SPARED = 8, 1 / 16
#: What a search counts: multiplications of all scores in full, those made, pairs of queries and lists, those passed over.
WORK = ("all", "made", "lists", "passed")


def quantized(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and floor(scale * x) of these, padded with zeros, as doubles."""
    n = len(column)
    lists = column.cast(pa.list_(pa.float64()))
    values, at = lists.values, np.array([x.as_py() for x in lists.offsets], np.int64)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    size = np.diff(at)
    valid = ~np.array(lists.is_null().to_numpy(zero_copy_only=False), bool)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    valid &= bad[at[1:]] == bad[at[:-1]]
    width = int(size[valid].max()) if valid.any() else 0
    out = np.zeros((int(valid.sum()), width))
    for row, k in enumerate(np.flatnonzero(valid)) if n and len(set(size[valid])) > 1 else ():
        out[row, : size[k]] = flat[at[k] : at[k + 1]]
    if len(set(size[valid])) == 1:
        out = flat[(at[:-1][valid][:, None] + np.arange(width)[None, :])]
    return valid, np.floor(scale * out)


def _packed(ids: np.ndarray, vectors: np.ndarray, kind: str, serial: int) -> list:
    order = np.argsort(ids, kind="stable")
    return [kind, serial, vectors.shape[1], ids[order].astype("<i8").tobytes(), np.ascontiguousarray(vectors[order], "<f8").tobytes()]


def blocks(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """Shards of all rows and blocks of the query rows: kind, serial (unique in a kind), width, ids, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {"shard": [], "query": []}

        def flush(kind: str) -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            parts = held[kind]
            held[kind] = []
            width = max(v.shape[1] for _, v in parts)
            vectors = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in parts])
            row = _packed(np.concatenate([i for i, _ in parts]), vectors, kind, serial)
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                valid, vectors = quantized(part.column(1))
                if not valid.any():
                    continue
                ids = part.column(0).filter(pa.array(valid)).to_numpy(zero_copy_only=False).astype(np.int64)
                for kind, mine in (("shard", np.ones(len(ids), bool)), ("query", ids % every == 0)):
                    if mine.any():
                        held[kind].append((ids[mine], vectors[mine]))
                        if sum(len(i) for i, _ in held[kind]) >= (SHARD_ROWS if kind == "shard" else BLOCK_ROWS):
                            yield flush(kind)
        for kind in held:
            if held[kind]:
                yield flush(kind)

    names = ["kind", "serial", "width", "ids", "vectors"]
    schema = pa.schema([("kind", pa.string()), ("serial", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
    return shared.bounded(rows).select("vec_id", "embedding").where("vec_id is not null").mapInArrow(run, "kind string, serial long, width int, ids binary, vectors binary")


def _unpacked(width: int, ids: pa.Scalar, vectors: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids.as_buffer(), "<i8")
    return i, np.frombuffer(vectors.as_buffer(), "<f8").reshape(len(i), width)


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that each term can add to each query's score where components lie between low and high."""
    return np.maximum(q * high, q * low)


class Shard:
    """Rows of a shard in lists of like rows, with the least and greatest component of each list in each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        strong = np.abs(vectors).argmax(1) if vectors.shape[1] else np.zeros(len(ids), np.int64)
        sign = np.take_along_axis(vectors, strong[:, None], 1)[:, 0] > 0 if vectors.shape[1] else strong > 0
        order = np.lexsort((ids, strong * 2 + sign))
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.by_id = np.argsort(self.ids, kind="stable")
        self.largest = float(np.abs(vectors).max(initial=0))
        self.starts = np.arange(0, len(ids), LIST_ROWS)
        self.low, self.high = (f.reduceat(self.vectors, self.starts, axis=0) for f in (np.minimum, np.maximum))

    def padded(self, width: int) -> Shard:
        return self if width <= self.vectors.shape[1] else Shard(self.ids, np.pad(self.vectors, ((0, 0), (0, width - self.vectors.shape[1]))))

    def own(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries, and the places of the rows that have their id."""
        known = self.ids[self.by_id]
        a, b = np.searchsorted(known, query_ids, "left"), np.searchsorted(known, query_ids, "right")
        return np.repeat(np.arange(len(query_ids)), b - a), self.by_id[np.concatenate([np.arange(x, y) for x, y in zip(a, b)] or [np.zeros(0, np.int64)]).astype(np.int64)]


def _ranked(row: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best of each query, by query, falling score and rising id."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < top]


def _traverse(q: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: np.ndarray, work: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place and score of the rows of one list that reach the thresholds: essential terms first, then the others while it is worth it."""
    bound = np.maximum(_bounds(q, low, high), 0)
    order = np.argsort(bound.mean(0), kind="stable")  # one order for all queries, so that their products go together
    rising = np.cumsum(bound[:, order], 1)
    spared = (rising < threshold[:, None]).sum(1)
    few = spared >= max(1, q.shape[1] * SPARED)
    found = []
    for mine, spare in ((np.flatnonzero(~few), 0), (np.flatnonzero(few), int(spared[few].min(initial=q.shape[1])))):
        if not len(mine):
            continue
        essential = order[spare:]
        score = (q[mine][:, essential] if spare else q[mine]) @ (v[:, essential] if spare else v).T
        work[1] += len(mine) * len(v) * len(essential)
        ahead = rising[mine, spare - 1] if spare else np.zeros(len(mine), q.dtype)
        row, place = np.nonzero(score + ahead[:, None] >= threshold[mine, None])
        total = score[row, place]
        for k in range(spare, 0, -STEP):  # the terms with the largest bounds first
            terms = order[max(0, k - STEP) : k]
            work[1] += len(row) * len(terms)
            total = total + np.einsum("ij,ij->i", q[mine[row]][:, terms], v[place][:, terms])
            rest = rising[mine, k - STEP - 1] if k > STEP else np.zeros(len(mine), q.dtype)
            alive = total + rest[row] >= threshold[mine[row]]
            row, place, total = row[alive], place[alive], total[alive]
        found.append((mine[row], place, total))
    return tuple(np.concatenate(x) for x in zip(*found))


def search(query_ids: np.ndarray, queries: np.ndarray, shard: Shard, best: np.ndarray, top: int = TOP, work: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, and ids and scores of the rows of one shard that can be among the ``top`` of each, that many at most.

    ``best`` holds the best scores of each query so far (falling, -inf where there are fewer) and is brought up to date, as is ``work``, by ``WORK``.
    A query without a threshold gets one from the list that promises it most.
    """
    work = np.zeros(len(WORK)) if work is None else work
    shard = shard.padded(queries.shape[1])
    width = shard.vectors.shape[1]
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    reach = float(np.abs(queries).max(initial=0)) * shard.largest * max(1, width)
    if reach >= 2.0**52:
        return _search_integers(query_ids, queries, shard.ids, shard.vectors, top)
    kind = np.float32 if reach < 2**23 else np.float64  # sums of whole numbers are exact in either
    q, v, low, high = (x.astype(kind, copy=False) for x in (queries, shard.vectors, shard.low, shard.high))
    threshold = best[:, top - 1].astype(kind)
    work[0] += len(q) * len(v) * width
    most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T if len(v) else np.zeros((len(q), 0), kind)
    cold = np.flatnonzero(~np.isfinite(threshold)) if len(shard.starts) > 1 else np.zeros(0, np.int64)
    promising = most[cold].argmax(1) if len(cold) else cold
    for k in np.unique(promising):
        some, at = cold[promising == k], int(shard.starts[k])
        score = q[some] @ v[at : at + LIST_ROWS].T
        work[1] += score.size * width
        score[shard.ids[None, at : at + LIST_ROWS] == query_ids[some, None]] = -np.inf
        if score.shape[1] >= top:
            threshold[some] = -np.partition(-score, top - 1, 1)[:, top - 1]
    cold = ~np.isfinite(threshold)
    parts = []
    if cold.any():
        some = np.flatnonzero(cold)
        score = q[some] @ v.T
        work[1] += score.size * width
        a, b = shard.own(query_ids[some])
        score[a, b] = -np.inf
        enough = -np.partition(-score, top - 1, 1)[:, top - 1] if score.shape[1] > top else np.full(len(some), -np.inf, kind)
        row, place = np.nonzero((score >= enough[:, None]) & (score > -np.inf))
        parts.append((some[row], place, score[row, place]))
    warm = np.flatnonzero(~cold)
    if len(warm):
        alive = most[warm] >= threshold[warm, None]
        work[2] += alive.size
        if alive.mean() > 0.5:  # hardly a list is passed over: all at once
            row, place, score = _traverse(q[warm], v, low.min(0), high.max(0), threshold[warm], work)
            parts.append((warm[row], place, score))
        else:
            work[3] += alive.size - alive.sum()
            for k in np.flatnonzero(alive.any(0)):
                some, at = warm[alive[:, k]], int(shard.starts[k])
                row, place, score = _traverse(q[some], v[at : at + LIST_ROWS], low[k], high[k], threshold[some], work)
                parts.append((some[row], place + at, score))
    row, place, score = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    ids = shard.ids[place]
    others = ids != query_ids[row]
    row, ids, score = row[others], ids[others], score[others].astype(np.float64)
    first = _ranked(row, ids, score, top)
    row, ids, score = row[first], ids[first], score[first]
    fresh = np.full((len(q), top), -np.inf)
    fresh[row, np.arange(len(row)) - np.searchsorted(row, row)] = score
    best[:] = -np.sort(-np.concatenate((best, fresh), 1), 1)[:, :top]
    return row, ids, score.astype(np.int64)


def _search_integers(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with whole numbers of any size."""
    limit = (1 << 63) - 1
    whole = [[int(x) for x in r] for r in vectors]
    found = []
    for k, (own, query) in enumerate(zip(query_ids, queries)):
        asked = [int(x) for x in query]
        scores = [max(-limit - 1, min(limit, sum(x * y for x, y in zip(r, asked)))) for r in whole]
        found += [(k, i, s) for s, i in sorted(((s, int(i)) for s, i in zip(scores, ids) if i != own), key=lambda x: (-x[0], x[1]))[:top]]
    return tuple(np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def top_k(rows: DataFrame, top: int = TOP, every: int = EVERY, count: Callable[[str, float], None] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score.  ``count`` is told in the tasks how much of each of ``WORK`` there was."""
    spark = rows.sparkSession
    packed, path = shared.written(blocks(rows, every), "vectors")
    shards = packed.where("kind = 'shard'")
    n = shards.count()
    ways = max(1, min(-(-n // LEAST_HELD), max(-(-n // HELD), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    numbered = with_row_number(shards.select("serial"), "number", [F.col("serial")])
    payload = ["serial", "width", "ids", "vectors"]
    held = shards.join(numbered, "serial").select(F.pmod("number", F.lit(ways)).cast("int").alias("bucket"), F.lit(0).alias("asks"), *payload)
    asked = packed.where("kind = 'query'").select(F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("bucket"), F.lit(1).alias("asks"), *payload)
    dealt = held.unionByName(asked).repartitionByRange(ways, "bucket").sortWithinPartitions("bucket", "asks", "serial")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, mine, work = None, [], np.zeros(len(WORK))
        for batch in batches:
            for k in range(batch.num_rows):
                at, asks, _, width, ids, vectors = (c[k] for c in batch.columns)
                if at.as_py() != bucket:
                    bucket, mine = at.as_py(), []
                ids, vectors = _unpacked(width.as_py(), ids, vectors)
                if not asks.as_py():
                    mine.append(Shard(ids, vectors.astype(np.float32) if np.abs(vectors).max(initial=0) < 2**23 else vectors))
                    continue
                best = np.full((len(ids), top), -np.inf)
                found = [search(ids, vectors, s, best, top, work) for s in mine]
                if found:
                    row, vec_id, score = (np.concatenate(x) for x in zip(*found))
                    first = _ranked(row, vec_id, score, top)
                    yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (ids[row], vec_id, score)], ["query_id", "vec_id", "score"])
        for name, much in zip(WORK, work.tolist()) if count else ():
            count(name, much)

    partial = shared.bounded(dealt).mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
