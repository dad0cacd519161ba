"""MinHash near-duplicate groups by a chosen-path similarity join.

Method.  A text is the set of its distinct five-word shingles.  Texts with equal sets form a class, known by a number of
its own, and one text of each class goes on.  Trees branch these sets by minwise tokens: a set goes to the
child named by its least token under a hash function of the node.  Several independent
functions branch the root; a node of at most ``SMALL`` sets is compared exhaustively, on full
sets; a larger one branches again with ``BRANCHES`` functions of its own, so sets that share only a
passage part quickly.  Two sets of similarity s part at the root with probability
(1 - s)**trees, and there are as many trees as bring that to ``MISS`` at the limit: 6 at 0.85, 7 at 0.8.

Large nodes are first compared in chunks of bounded size, each with the same few pivots, which
joins a large group of near copies into one component without looking at all its pairs.  A node whose sets are all
in one component is done.  A node that branching would not thin out, or that
is more than ``DEPTH`` deep, is settled exactly: its sets are compared with each other chunk by chunk, but for pairs that are in
one component or met in a node that was settled before.  Nothing is capped: each pair of a node is compared, parted by
branching or joined already.

Scale.  Scanning gives a narrow table (sizes, fingerprints, minwise tokens).  Shuffles before the
comparison carry ids only.  Sets are sent to a task only for nodes with two or more components, in chunks
of at most ``SMALL`` sets (and ``TOKENS`` tokens, or one set).  Ids are broadcast only after counting
that they are few; otherwise both sides are shuffled.  Components come from distributed
label propagation with pointer jumping over star-shaped links.

Edge cases.  Null, empty and wordless texts have empty sets: no links, their own component, kept.  A null id
has a null component and is kept.  Rows that repeat an id are one document to ``groups``, whatever their texts: what any of them is linked
with is in the id's component.  To ``keep_one`` they are as many documents as they have different texts, and
one row stays of each group of texts.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columnar, shared

WIDTH = 5
#: Linked if 100 * shared >= percent * union.
PERCENT = 85
#: How likely two sets at the limit may part at the roots of all trees.
MISS = 1.3e-5
BRANCHES, DEPTH = 2, 16
SMALL, PIVOTS, TOKENS = 192, 6, 1 << 19
#: How much wider chunks are where all are compared with all, as each set then goes to fewer tasks.
WIDER = 6
#: A child with this share of its parent's sets has not been thinned out.
DENSE = 0.7
#: Rows of ids (up to 24 bytes each) that may be broadcast.
BROADCAST_ROWS = 1 << 20
#: Links (16 bytes each) that one task may join.
FEW_LINKS = 1 << 20

_SEEDS = columnar.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingles(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The set of hashed shingles of each row, sorted."""
    starts, ends = columnar.words(data, offsets)
    word = columnar.span_hashes(data, starts, ends, columnar.LOWER_CODE)
    edge = np.searchsorted(columnar.rows_of(starts, offsets), np.arange(len(offsets)))
    for k in range(len(offsets) - 1):
        own = word[edge[k] : edge[k + 1]]
        yield np.unique(columnar.runs_hash(own, min(WIDTH, len(own)))) if len(own) else own


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = columnar.utf8(column)
    for i, j in columnar.blocks(offsets):
        yield from shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def trees_for(percent: int) -> int:
    """The number of trees at which sets at the limit part at every root with probability ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log(1 - percent / 100))


def _text_hash() -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64("text")


def facts(documents: DataFrame, trees: int) -> DataFrame:
    """doc_id, a hash of the text, size of the set, its fingerprint (two longs) and its minwise token for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, out = np.zeros(n, np.int64), np.zeros((2 + trees, n), np.uint64)
            for k, s in enumerate(_sets(batch.column(1))):
                if size_k := len(s):
                    size[k] = size_k
                    out[0, k], out[1, k] = np.bitwise_xor.reduce(columnar.mix(s)), columnar.mix(s ^ _SEEDS[63]).sum()
                    for t in range(trees):
                        out[2 + t, k] = columnar.mix(s ^ _SEEDS[t]).min()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), *map(_signed, out)], ["doc_id", "text_hash", "n_shingles", "f1", "f2", *(f"h{t}" for t in range(trees))])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return shared.bounded(documents).select("doc_id", "text", _text_hash().alias("text_hash")).mapInArrow(shared.released(run), f"doc_id {kind}, text_hash long, n_shingles long, f1 long, f2 long, " + ", ".join(f"h{t} long" for t in range(trees)))


def _few(rows: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """``other`` joined with written rows of ids: they are broadcast if counted to be few."""
    return other.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, key)


def set_table(documents: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and set (sorted tokens as bytes) of the classes named, from the text that stands for each (``one``: id and hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in _sets(part.column(1))], pa.binary())], ["rep", "tokens"])

    named = shared.bounded(reps).select("rep", "one.doc_id", "one.text_hash")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    return documents.select("doc_id", "text", _text_hash().alias("text_hash")).join(named, ["doc_id", "text_hash"]).select("rep", "text").mapInArrow(shared.released(run), "rep long, tokens binary")


def links(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each of a few sets, the least place of a set that it is joined with by links among them."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    root = np.arange(m)
    if m == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        linked = 100 * common >= percent * (size.sum() - common)
        return np.zeros(2, np.int64) if linked else root
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(root, size)
    often = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[often]]
    owner = owner[often]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common, width = np.zeros((m, m), np.float32), 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        block = np.zeros((m, width), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        common += block @ block.T
    shared_tokens = common.astype(np.int64)
    linked = 100 * shared_tokens >= percent * (size[:, None] + size[None, :] - shared_tokens)
    np.fill_diagonal(linked, True)
    while True:  # least place reachable
        least = np.where(linked, root[None, :], m).min(1)
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def compare(rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """Links (a, b) between the components that the rows (node, rep, comp) of each node join, a < b, as a written table.

    Nodes are of bounded size.  A node gives one link for each component that it joins to another, none for what is joined already.
    """
    spark = rows.sparkSession
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held, held_path = shared.written(rows.select("node", "rep", "comp"), "rows")
    joined = _few(held, "rep", sets).select("node", "rep", "comp", "tokens")
    dealt = joined.repartition(ways, "node").sortWithinPartitions("node", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, reps, comps, tokens = None, [], [], []

        def found() -> Iterator[pa.RecordBatch]:
            if len(set(comps)) > 1:
                pairs = np.unique(np.stack([links(tokens, percent), np.array(comps)]), axis=1)  # by place of the group, then component
                same = pairs[0, 1:] == pairs[0, :-1]
                first = np.concatenate(([0], np.where(same, 0, np.arange(1, pairs.shape[1]))))
                least = pairs[1][np.maximum.accumulate(first)]
                if same.any():
                    yield pa.RecordBatch.from_arrays([pa.array(least[1:][same]), pa.array(pairs[1, 1:][same])], ["a", "b"])

        for batch in batches:
            for key, rep, comp, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if key != node:
                    yield from found()
                    node, reps, comps, tokens = key, [], [], []
                if not reps or reps[-1] != rep:  # a pivot may also be a member
                    reps.append(rep)
                    comps.append(comp)
                    tokens.append(np.frombuffer(raw.as_buffer(), np.uint64))
        yield from found()

    out = shared.written(shared.bounded(dealt).mapInArrow(shared.released(run), "a long, b long"), "links")
    shared.drop(spark, held_path)
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the links (a, b), and the least end that it is joined with."""
    ends, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(ends))
    while True:
        new = root.copy()
        np.minimum.at(new, root[x], root[y])
        np.minimum.at(new, root[y], root[x])
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == root).all():
            return ends, ends[root]
        root = new


def components(edges: DataFrame, few: int = FEW_LINKS) -> tuple[DataFrame, str]:
    """comp and least (the least id reachable) for every end of a link, as a written table.

    Up to ``few`` links, counted first, fit one task; more are settled by label propagation with pointer jumping.
    """
    spark = edges.sparkSession
    if edges.count() <= few:

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if parts:
                ends, least = _joined(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(least)], ["comp", "least"])

        return shared.written(edges.coalesce(1).mapInArrow(shared.released(settle), "comp long, least long"), "labels")
    both, both_path = shared.written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now, path = shared.written(both.groupBy(F.col("a").alias("comp")).agg(F.least(F.col("a"), F.min("b")).alias("least")), "labels")
    while True:
        heard = both.join(now, both["b"] == now["comp"]).groupBy(both["a"].alias("comp")).agg(F.min("least").alias("heard"))
        step = now.join(heard, "comp").select("comp", F.least("least", "heard").alias("least"))
        far = now.select(F.col("comp").alias("least"), F.col("least").alias("beyond"))
        new = step.join(far, "least", "left").select("comp", F.least("least", F.coalesce("beyond", "least")).alias("least"))
        done, new_path = shared.written(new, "labels")
        # labels only fall, so an equal sum means that none has changed
        before, after = (x.agg(F.sum(F.col("least").cast("decimal(38,0)"))).first()[0] for x in (now, done))
        shared.drop(spark, path)
        now, path = done, new_path
        if before == after:
            shared.drop(spark, both_path)
            return now, path


def relabel(labels: DataFrame | None, path: str | None, rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """rep and comp of every set that is not the least of its component, after the links that the rows give."""
    spark = rows.sparkSession
    edges, edges_path = compare(rows, sets, percent)
    joined, joined_path = components(edges)
    new = joined.where("comp <> least").select(F.col("comp").alias("rep"), F.col("least").alias("comp"))
    if labels is not None:
        moved = labels.join(joined, "comp", "left").select("rep", F.coalesce("least", "comp").alias("comp"))
        new = moved.unionByName(new)
    out = shared.written(new, "labels")
    shared.drop(spark, edges_path, joined_path, *([path] if path else []))
    return out


def _bucket(column: Column, *salts: Column | int) -> Column:
    return F.xxhash64(column, *(s if isinstance(s, Column) else F.lit(s) for s in salts))


def _impure(nodes: DataFrame, labels: DataFrame | None, settled: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """What is left to do: the nodes whose sets are neither in one component nor compared with each other already.

    Rows (node, rep, n, comp, key, chunks, m), chunks being 1 for small nodes; pairs of one key need no comparison.
    For each large node (node, chunks, pivots); the paths of both tables.
    """
    held = nodes.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")) if labels is not None else nodes.withColumn("comp", F.col("rep"))
    held = held.join(settled.select("rep", "sid"), "rep", "left").withColumn("key", F.coalesce("sid", "comp")).drop("sid") if settled is not None else held.withColumn("key", F.col("comp"))
    picks = F.array(*(F.min_by(F.struct("rep", "comp"), _bucket(F.col("rep"), k)) for k in range(PIVOTS))).alias("pivots")
    ends = [f(c).alias(f"_{c}{k}") for c in ("comp", "key") for k, f in enumerate((F.min, F.max))]
    found = held.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"), *ends, picks)
    found = found.where("_comp0 < _comp1 and _key0 < _key1").withColumn("chunks", _chunks())
    found, path = shared.written(found.select("node", "m", "chunks", F.when(F.col("chunks") > 1, F.col("pivots")).alias("pivots")), "nodes")
    names = ["node", "rep", "n", "comp", "key", *(["tree"] if "tree" in nodes.columns else [])]
    small = held.join(found.where("chunks = 1").select("node"), "node", "left_semi").select(*names, F.lit(1).alias("chunks"), F.lit(None).cast("long").alias("m"))
    large = held.join(found.where("chunks > 1").drop("pivots"), "node").select(*names, "chunks", "m")
    live, live_path = shared.written(small.unionByName(large), "live")
    return live, found.where("chunks > 1").select("node", "chunks", "pivots"), [path, live_path]


def _chunks() -> Column:
    """Into how many chunks a node goes; 1 if it is small."""
    small = (F.col("m") <= SMALL) & (F.col("tokens") <= TOKENS)
    return F.when(small, 1).otherwise(F.ceil(F.greatest(F.col("m") / (SMALL // 2), F.col("tokens") / (TOKENS // 2))).cast("int") + 1)


def _groups(live: DataFrame, pivots: DataFrame) -> DataFrame:
    """Rows (node, rep, comp) to compare: small nodes whole, large ones in chunks, each with the node's pivots."""
    small = live.where("chunks = 1").select("node", "rep", "comp")
    own = live.where("chunks > 1").select(_bucket(F.col("node"), F.pmod(_bucket(F.col("rep"), 71), F.col("chunks"))).alias("node"), "rep", "comp")
    spread = pivots.select("node", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), "pivots")
    spread = spread.select(_bucket(F.col("node"), F.col("c").cast("long")).alias("node"), F.explode("pivots").alias("p")).select("node", "p.rep", "p.comp")
    return small.unionByName(own).unionByName(spread)


def _exact(live: DataFrame) -> DataFrame:
    """Rows (node, rep, comp) that bring every set outside the most frequent key of a node together with every other set of it."""
    counts = live.groupBy("node", "key").agg(F.count(F.lit(1)).alias("c"))
    most = counts.groupBy("node").agg(F.max_by("key", F.struct("c", "key")).alias("_most"), (F.sum("c") - F.max("c")).alias("_rare"))
    live = live.join(most, "node").withColumn("chunks", F.ceil(F.col("chunks") / WIDER).cast("int")).withColumn("rare_chunks", F.ceil(F.col("chunks") * F.col("_rare") / F.col("m")).cast("int"))
    slot = _bucket(F.col("rep"), 72)
    every = live.select("node", "rep", "comp", F.pmod(slot, F.col("chunks")).alias("j"), F.explode(F.sequence(F.lit(0), F.col("rare_chunks") - 1)).alias("i"))
    few = live.where("key <> _most").select("node", "rep", "comp", F.pmod(slot, F.col("rare_chunks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    return every.select(_bucket(F.col("node"), F.col("i").cast("long"), F.col("j").cast("long")).alias("node"), "rep", "comp").unionByName(few.select(_bucket(F.col("node"), F.col("i").cast("long"), F.col("j").cast("long")).alias("node"), "rep", "comp"))


def _branch(live: DataFrame, sets: DataFrame) -> DataFrame:
    """Children of large nodes: (node, rep, n, parent), by functions that belong to the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            children = np.zeros((batch.num_rows, BRANCHES), np.uint64)
            for k, raw in enumerate(batch.column(2)):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                own = node[k : k + 1].astype(np.int64).view(np.uint64)
                for b in range(BRANCHES):
                    seed = columnar.mix(own + _SEEDS[32 + b])
                    children[k, b] = columnar.mix(columnar.mix(s ^ seed).min()[None] + seed)[0]
            size = [len(raw.as_buffer()) // 8 for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([_signed(children.ravel()), pa.array(np.repeat(rep, BRANCHES)), pa.array(np.repeat(size, BRANCHES)), pa.array(np.repeat(node, BRANCHES))], ["node", "rep", "n", "parent"])

    return _few(shared.bounded(live).select("node", "rep"), "rep", sets).select("node", "rep", "tokens").mapInArrow(shared.released(run), "node long, rep long, n long, parent long")


def classes(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every row's doc_id, text_hash, n_shingles, and, if it has an id and words, comp and one, as a written table.

    comp numbers a component of texts that are linked from a similarity of ``percent`` on; one is the least (doc_id, text_hash) of it.
    """
    spark = documents.sparkSession
    trees = trees_for(percent)
    seen, seen_path = shared.written(facts(documents, trees), "facts")
    same = ["f1", "f2", "n_shingles"]
    whole = seen.where("n_shingles > 0 and doc_id is not null")
    held = whole.groupBy(*same).agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), *(F.first(f"h{t}").alias(f"h{t}") for t in range(trees)))
    reps, reps_path = shared.written(held.withColumn("rep", F.monotonically_increasing_id()), "classes")

    of_tree = [F.struct(F.lit(t).alias("tree"), _bucket(F.col(f"h{t}"), t).alias("node"), F.col("rep"), F.col("n_shingles").alias("n")) for t in range(trees)]
    nodes = reps.select(F.explode(F.array(*of_tree)).alias("x")).select("x.*")
    live, pivots, paths = _impure(nodes, None)
    asked, asked_path = shared.written(live.select("rep").distinct().join(reps.select("rep", "one"), "rep"), "named")
    sets, sets_path = shared.written(set_table(documents, asked), "sets")
    labels, labels_path = None, None
    settled, settled_path = None, None
    # trees by turns: what one has joined or compared, the next need not send its sets for again
    for part in (live.where("tree = 0"), live.where("tree = 1"), live.where("tree = 2"), live.where("tree > 2")):
        todo = part.select("node", "rep", "n")
        for depth in range(1, DEPTH + 2):
            now, pivots, now_paths = _impure(todo, labels, settled)
            if now.isEmpty():
                shared.drop(spark, *now_paths)
                break
            labels, labels_path = relabel(labels, labels_path, _groups(now, pivots), sets, percent)
            large = now.where("chunks > 1")
            if large.isEmpty():
                shared.drop(spark, *now_paths)
                break
            left, _, left_paths = _impure(large.select("node", "rep", "n"), labels, settled)
            shared.drop(spark, *now_paths)
            children, children_path = shared.written(_branch(left, sets), "children")
            share = children.groupBy("parent", "node").count().groupBy("parent").agg(F.max("count").alias("most"))
            crowded = left.select("node", "m").distinct().join(share, left["node"] == share["parent"]).where((F.col("most") >= DENSE * F.col("m")) | F.lit(depth > DEPTH)).select("node")
            crowded, crowded_path = shared.written(crowded, "crowded")
            dense = left.join(crowded, "node", "left_semi")
            if not crowded.isEmpty():
                labels, labels_path = relabel(labels, labels_path, _exact(dense), sets, percent)
                new = dense.select("rep", F.col("node").alias("sid"), F.col("m").alias("size"))
                new = (settled.unionByName(new) if settled is not None else new).groupBy("rep").agg(F.max_by("sid", F.struct("size", "sid")).alias("sid"), F.max("size").alias("size"))
                new, new_path = shared.written(new, "settled")
                if settled_path:
                    shared.drop(spark, settled_path)
                settled, settled_path = new, new_path
            thin, thin_path = shared.written(children.join(crowded, children["parent"] == crowded["node"], "left_anti").select("node", "rep", "n"), "thin")
            shared.drop(spark, children_path, *left_paths, crowded_path)
            todo = thin
            paths.append(thin_path)
    shared.drop(spark, *paths, asked_path, sets_path, *([settled_path] if settled_path else []))
    if labels is None:
        labels = spark.createDataFrame([], "rep long, comp long")
    of_others = labels.join(reps.select("rep", "one"), "rep").groupBy("comp").agg(F.min("one").alias("least"))
    of_all = of_others.join(reps.select(F.col("rep").alias("comp"), "one"), "comp").select("comp", F.least("least", "one").alias("least"))
    joined = reps.select(*same, "rep", "one").join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    joined = joined.join(of_all, "comp", "left").select(*same, "comp", F.coalesce("least", "one").alias("one"))
    out = seen.where("n_shingles > 0 and doc_id is not null").select("doc_id", "text_hash", *same).join(joined, same)
    names = ["doc_id", "text_hash", "n_shingles", "comp", "one"]
    rest = seen.where("not (n_shingles > 0 and doc_id is not null)").select(*names[:3], F.lit(None).cast("long").alias("comp"), F.lit(None).cast(reps.schema["one"].dataType).alias("one"))
    found, _ = shared.written(out.select(names).unionByName(rest), "found")
    shared.drop(spark, seen_path, reps_path, *([labels_path] if labels_path else []))
    return found


def groups(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; documents are linked from a similarity of ``percent`` on."""
    spark = documents.sparkSession
    rows = classes(documents, percent).select("doc_id", "n_shingles", "comp", F.col("one.doc_id").alias("least"))
    spans = rows.where("comp is not null").groupBy("doc_id").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("doc_id", "a")
    spans, spans_path = shared.written(spans, "spans")
    if spans.isEmpty():  # no id has texts of two components
        shared.drop(spark, spans_path)
    else:
        edges = rows.where("comp is not null").join(spans, "doc_id").where("a < comp").select("a", F.col("comp").alias("b")).distinct()
        merged, merged_path = components(edges)
        merged = merged.withColumnRenamed("least", "root")
        lowest = rows.where("comp is not null").join(merged, "comp").groupBy("root").agg(F.min("least").alias("lowest"))
        merged, _ = shared.written(merged.join(lowest, "root").select("comp", "lowest"), "merged")
        shared.drop(spark, spans_path, merged_path)
        rows = rows.join(merged, "comp", "left").withColumn("least", F.coalesce("lowest", "least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of texts, with all its columns: the one of the least id, then of the least hash of its text.

    Of rows that repeat an id and its text any one stays.  Rows without an id stay, and so do those without words, one for each id and text.
    """
    spark = documents.sparkSession
    found = classes(documents, percent).where("doc_id is not null")
    key = ["doc_id", "text_hash"]
    found = found.groupBy(*key).agg(F.first(F.coalesce((F.col("doc_id") != F.col("one.doc_id")) | (F.col("text_hash") != F.col("one.text_hash")), F.lit(False))).alias("goes"), F.count(F.lit(1)).alias("n")).where("goes or n > 1")
    gone, _ = shared.written(found, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    other = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"), "goes", "n")
    aside = {c: f"_{k}" for k, c in enumerate(documents.columns) if c not in ("doc_id", "text")}  # columns of any name pass through
    inside = documents.select("doc_id", "text", *(F.col(f"`{c}`").alias(a) for c, a in aside.items()))
    joined = inside.join(other, (F.col("doc_id") == F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_hash")), "left")
    kept = joined.where("goes is null or not goes")
    if not gone.where("not goes").isEmpty():  # repeated rows
        twice = kept.where("goes is not null")
        kept = kept.where("goes is null").unionByName(twice.dropDuplicates(["_gone_id", "_gone_hash"]))
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in documents.columns))
