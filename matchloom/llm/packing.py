"""Best-fit packing of token documents into sequences of a fixed capacity, in bulk-synchronous supersteps.

Method.  Documents are tokenized and only those longer than the capacity are cut.  Pieces go class by class, the
longest first (``CLASSES``).  In a superstep the pieces of a class and the gaps (what sequences have left) are range-sorted together,
falling by size.  Each piece asks for its successor, the smallest gap that holds it; of several that ask
for one gap the first by rank gets it and the others go on to the next.  In falling order that is the matching of brackets, gaps
opening and pieces closing: every range is swept for itself, and what it leaves (pieces first,
then gaps) is matched between ranges by the numbers left over in each.  Gaps are updated by what they got, and the
step repeats.  A gap that is wider than the class stands for as many brackets as it surely holds pieces.  Pieces that
no gap holds open sequences, as many to one as fit, and what these have left are new gaps.

Scale.  Tokenizing is a map pass; each superstep shuffles the pieces of one class and the gaps that can serve them, and a last
shuffle puts each sequence (at most ``capacity`` pieces) in order.  Pieces and gaps are never on the driver: it sees counts by length and
by room, at most ``capacity`` each, and two counts for each range.  Ranges are cut by size and id, so a length that a third of all
pieces have is no hot key, and there are as many as keep a task at about ``TASK_ROWS`` rows.  Gaps beyond those
that all pieces of the class need are left out of the step, smallest kept.

Edge cases.  Null text reads as empty and is one token long (the closing id 0).  Repeated rows and null ids are
packed like any other.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

CAPACITY = 2048
CLOSING = 0
#: Lengths above capacity / k make a class with those up to the next longer bound.
CLASSES = (2, 3, 4, 6, 10, 20, 50, 200)
#: How often a class meets the gaps before the pieces left open sequences.
SWEEPS = 2
#: Rows of pieces and gaps that a task sweeps.
TASK_ROWS = 1 << 18
#: Brackets that a row of a gap opens, at most.
ROW_SLOTS = 2
#: Fixed: how byte-level BPE files of this family cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of one kind of character for which the faster library's pattern engine can give up.
_LONG_RUN = re.compile(r"\s{2000}|\S{20000}")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest counts up from U+0100."""
    own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encodes with the vocabulary of a byte-level BPE file; the ids are those of the tokenizers library, which adds no tokens of its own.

    Texts that hold the name of an added token, or runs that the faster library can give up on, go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        self.plain = tokenizers.Tokenizer.from_file(path)
        special = {t.content for t in self.plain.get_added_tokens_decoder().values()}
        self.odd = re.compile("|".join([_LONG_RUN.pattern, *map(re.escape, sorted(special))]))
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in name): i for name, i in self.plain.get_vocab().items() if name not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        if self.odd.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def cut(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, the ids of every piece; a first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            rows, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                tokens = np.append(encode(text.as_py() or ""), np.array([CLOSING], "<u4"))
                edges = [0, *range((len(tokens) - 1) % capacity + 1, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(row)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(tokens[a:b].tobytes()))
                    if with_ids:
                        ids.append(tokens[a:b].astype(np.int32))
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""
    return shared.bounded(documents).select("doc_id", "text").mapInArrow(shared.released(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{extra}")


def matched(brackets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the closing (-1) and of the opening (1) brackets that belong together."""
    depth = np.cumsum(brackets, dtype=np.int64)
    level = np.where(brackets > 0, depth, depth + 1)
    order = np.argsort(level, kind="stable")  # brackets of one level take turns
    kind, level = brackets[order], level[order]
    at = np.flatnonzero((level[1:] == level[:-1]) & (kind[1:] < 0) & (kind[:-1] > 0))
    return order[at + 1], order[at]


def _numbers(left: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n rows, the number (from 0) of its first bracket that is left, and how many are; ``row`` is that of each bracket."""
    count = np.bincount(row[left], minlength=n)
    return np.cumsum(count) - count, count


def _names(piece: T.StructType) -> list[Column]:
    """What tells pieces of one length apart, where they have it."""
    return [F.col(f"p.{c}") for c in ("doc_id", "piece", "ids_crc32") if c in piece.names]


def _dealt(todo: DataFrame, gaps: DataFrame, low: int, high: int, ways: int) -> DataFrame:
    """Brackets in ranges, sorted: gaps open as many as they surely hold pieces, in rows of ``ROW_SLOTS`` so that ranges of like numbers of rows are of like weight; pieces close."""
    kind_of_piece = todo.schema["p"].dataType
    slots = F.array(F.struct(F.lit(high).alias("size"), F.floor(F.col("room") / high).alias("n")), F.struct((F.col("room") % high).cast("int").alias("size"), F.lit(1).cast("long").alias("n")))
    opening = gaps.select("sequence", "room", F.explode(slots).alias("s")).where((F.col("s.n") > 0) & (F.col("s.size") > low))
    opening = opening.select("sequence", "room", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.n") - 1, F.lit(ROW_SLOTS).cast("long"))).alias("first"))
    weight = F.least(F.lit(ROW_SLOTS).cast("long"), F.col("s.n") - F.col("first"))
    opening = opening.select(F.lit(1).alias("bracket"), F.col("s.size").alias("size"), "room", "sequence", weight.alias("n"), F.lit(None).cast(kind_of_piece).alias("p"), F.col("sequence").alias("tie"))
    tie = F.xxhash64(*_names(kind_of_piece), F.monotonically_increasing_id())
    closing = todo.select(F.lit(-1).alias("bracket"), F.col("p.length").cast("int").alias("size"), F.lit(0).alias("room"), F.lit(-1).cast("long").alias("sequence"), F.lit(1).cast("long").alias("n"), "p", tie.alias("tie"))
    key = [F.desc("size"), F.desc("bracket"), F.desc("room"), F.asc("tie")]
    return opening.unionByName(closing).repartitionByRange(ways, *key).sortWithinPartitions(*key).select("bracket", "sequence", "n", "p")


def _sweep(todo: DataFrame, gaps: DataFrame, low: int, high: int, ways: int) -> tuple[DataFrame, DataFrame, int, list[str]]:
    """One superstep over pieces (p) with lengths in (low, high]: what got a gap (p, sequence), the pieces left, how many got one, and the tables written."""
    spark, kind_of_piece = todo.sparkSession, todo.schema["p"].dataType
    dealt = _dealt(todo, gaps, low, high, ways)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bracket, sequence, n = (table[k].to_numpy() for k in range(3))
        row = np.repeat(np.arange(len(n)), n)
        close, open_ = matched(bracket[row])
        sequence = sequence.copy()
        sequence[row[close]] = sequence[row[open_]]
        left = np.ones(len(row), bool)
        left[close] = left[open_] = False
        at, many = (np.where(bracket > 0, o, c) for o, c in zip(_numbers(left & (bracket[row] > 0), row, len(n)), _numbers(left & (bracket[row] < 0), row, len(n))))
        told = np.flatnonzero((bracket < 0) | (many > 0))
        out = [pa.array(x[told]) for x in (bracket, sequence, at.astype(np.int64), many.astype(np.int64))]
        bucket = pa.array(np.full(len(told), TaskContext.get().partitionId(), np.int32))
        for batch in pa.table([*out, bucket, table["p"].take(pa.array(told))], names=[f.name for f in schema]).combine_chunks().to_batches(1 << 16):
            yield batch

    schema = T.StructType([T.StructField("bracket", T.IntegerType()), T.StructField("sequence", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("p", kind_of_piece)])
    swept, path = shared.written(shared.bounded(dealt).mapInArrow(shared.released(run), schema), "swept")
    # what ranges leave: pieces take from the nearest range before theirs that has gaps left, the last left first
    left: dict[int, list[int]] = {}
    got = pieces = 0
    for r in swept.groupBy("bucket").agg(F.sum(F.when(F.col("bracket") > 0, F.col("n")).otherwise(0)).alias("o"), F.sum(F.when(F.col("bracket") < 0, F.col("n")).otherwise(0)).alias("c"), F.count_if(F.col("bracket") < 0).alias("pieces")).collect():
        left[r["bucket"]] = [r["o"], r["c"]]
        pieces += r["pieces"]
        got += r["pieces"] - r["c"]
    stack: list[list[int]] = []
    runs, taken, rest = [], [], []
    for bucket in sorted(left):
        opens, closes = left[bucket]
        first = 0
        while first < closes and stack:
            use = min(stack[-1][1], closes - first)
            runs.append((bucket, first, use, stack[-1][0], stack[-1][1] - 1))
            first += use
            stack[-1][1] -= use
            if not stack[-1][1]:
                taken.append((stack.pop()[0], 0))
        got += first
        rest.append((bucket, first))
        if opens:
            stack.append([bucket, opens])
    taken += [tuple(x) for x in stack]
    closed = swept.where("bracket < 0")
    placed = closed.where("sequence >= 0").select("p", "sequence")
    open_pieces = closed.where("sequence < 0")
    if not runs:  # all matches are within ranges, and written
        return placed, open_pieces.select("p"), got, []
    run_table, from_table = spark.createDataFrame(runs, "bucket int, first long, use long, `from` int, top long"), spark.createDataFrame(taken, "bucket int, low long")
    asked = open_pieces.join(F.broadcast(run_table), "bucket").where("at >= first and at < first + use").select("p", F.col("from").alias("bucket"), (F.col("top") - (F.col("at") - F.col("first"))).alias("k"))
    given = swept.where("bracket > 0").join(F.broadcast(from_table), "bucket").where("at + n > low").select("bucket", "sequence", F.explode(F.sequence(F.greatest("at", "low"), F.col("at") + F.col("n") - 1)).alias("k"))
    placed = placed.unionByName(asked.join(given, ["bucket", "k"]).select("p", "sequence"))
    rest_table = spark.createDataFrame(rest, "bucket int, first long")
    todo = open_pieces.join(F.broadcast(rest_table), "bucket").where("at >= first").select("p")
    return shared.written(placed, "placed")[0], todo, got, [path]


def _open(todo: DataFrame, step: int, capacity: int, ways: int) -> DataFrame:
    """p, sequence, and the room of the sequence at its last piece: the pieces in new sequences, longest first, as many to one as fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = (step << 48) | (TaskContext.get().partitionId() << 28)
        for batch in batches:
            length = batch.column(0).field("length").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(-length, kind="stable")
            total = np.concatenate(([0], np.cumsum(length[order])))
            at, sequence, room = 0, np.zeros(len(order), np.int64), np.full(len(order), -1, np.int32)
            while at < len(order):
                to = int(np.searchsorted(total, total[at] + capacity, "right")) - 1
                sequence[at:to] = opened
                room[to - 1] = capacity - (total[to] - total[at])
                at, opened = to, opened + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(order)), pa.array(sequence), pa.array(room)], ["p", "sequence", "room"])

    schema = T.StructType([*todo.schema, T.StructField("sequence", T.LongType()), T.StructField("room", T.IntegerType())])
    return shared.bounded(todo.coalesce(ways)).mapInArrow(shared.released(run), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces, with all their columns, and the sequence_id and offset of each.  ``pieces`` should be a written table."""
    spark = pieces.sparkSession
    if clash := {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"columns {sorted(clash)} are set by packing")
    count = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if odd := [n for n in count if n is None or not 0 < n <= capacity]:
        raise ValueError(f"lengths out of range: {odd[:5]}")
    held = pieces.select(F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("p"))
    ways = lambda n: max(1, -(-n // TASK_ROWS))
    placed: list[DataFrame] = []
    gaps, gaps_path, rooms = None, None, {}
    bounds = [capacity, *(capacity // k for k in CLASSES if capacity // k), 0]
    for step, (high, low) in enumerate(zip(bounds, bounds[1:])):
        mine = [n for n in count if low < n <= high]
        left = sum(count[n] for n in mine)
        if not left:
            continue
        todo, temporary = held.where((F.col("p.length") > low) & (F.col("p.length") <= high)), []
        least = min(n for n in count if n <= high)  # gaps with less room are of no use any more
        for _ in range(SWEEPS):
            wide = sorted(r for r in rooms if r >= min(mine))
            if not left or not wide:
                break
            slots, most = 0, wide[-1]
            for r in wide:
                slots += rooms[r] * max(1, r // high)
                if slots >= left and r >= high:
                    most = r
                    break
            use = gaps.where((F.col("room") > low) & (F.col("room") <= most))
            found, todo, got, paths = _sweep(todo, use, low, high, ways(slots + left))
            temporary += paths
            if not got:
                break
            placed.append(found)
            left -= got
            used = found.groupBy("sequence").agg(F.sum("p.length").alias("used"))
            after = gaps.join(used, "sequence", "left").select("sequence", (F.col("room") - F.coalesce("used", F.lit(0))).cast("int").alias("room")).where(F.col("room") >= least)
            gaps, gaps_path, rooms = _kept(after, gaps_path)
        if left:
            found, _ = shared.written(_open(todo, step, capacity, ways(left)), "placed")
            placed.append(found.select("p", "sequence"))
            new = found.where(F.col("room") >= least).select("sequence", "room")
            gaps, gaps_path, rooms = _kept(gaps.unionByName(new) if gaps is not None else new, gaps_path)
        shared.drop(spark, *temporary)
    if gaps_path:
        shared.drop(spark, gaps_path)
    if not placed:
        return spark.createDataFrame([], T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    whole = placed[0]
    for part in placed[1:]:
        whole = whole.unionByName(part)
    before = Window.partitionBy("sequence").orderBy(F.desc("p.length"), *_names(held.schema["p"].dataType)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return whole.select("p.*", F.col("sequence").alias("sequence_id"), (F.sum("p.length").over(before) - F.col("p.length")).cast("long").alias("offset"))


def _kept(gaps: DataFrame, last: str | None) -> tuple[DataFrame, str, dict[int, int]]:
    """The gaps as a written table, and how many there are of each room; the table before goes."""
    table, path = shared.written(gaps, "gaps")
    if last:
        shared.drop(gaps.sparkSession, last)
    return table, path, {r["room"]: r["count"] for r in table.groupBy("room").count().collect()}


def best_fit(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces, mine = shared.written(cut(documents, path, capacity), "pieces")
    packed = pack(pieces, capacity)
    shared.drop(documents.sparkSession, mine)
    return packed
