"""What operators leave in the shared folder, and how much of a table workers get."""

import os
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import DOCUMENTS, corpus
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import html, lines, neardup, packing, shared, topk


def held(spark):
    top = shared.folder(spark) + "/matchloom"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


OPERATORS = {
    "html": lambda spark, docs: html.extract(spark.createDataFrame([(k, "http://a.example/", f"<div>top</div><p>{k}</p>") for k in range(15)], "page_id long, url string, html string")),
    "lines": lambda spark, docs: lines.clean(docs, F.col("source")),
    "neardup": lambda spark, docs: neardup.groups(docs),
    "keep_one": lambda spark, docs: neardup.keep_one(docs),
    "packing": lambda spark, docs: packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), 64),
    "topk": lambda spark, docs: topk.top_k(spark.createDataFrame([(k, [0.5, float(k)]) for k in range(50)], "vec_id long, embedding array<float>")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nothing_is_left_behind(spark, name):
    docs = spark.createDataFrame(corpus(40)[0], DOCUMENTS)
    before = held(spark)
    with shared.scope(spark) as keep:
        table, path = keep(OPERATORS[name](spark, docs), "result")
        assert table.count()
    assert held(spark) - before == {os.path.basename(path)}
    shared.drop(spark, path)
    assert held(spark) == before


def test_the_pipeline_keeps_one_stage_at_a_time(spark, tmp_path):
    rows, labels = corpus(60)
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = held(spark)
    with shared.scope(spark) as keep:
        _, path = keep(corpus_pipeline.run(spark, str(tmp_path)), "result")
        names = {x.split("-")[0] for x in held(spark) - before}
        assert not names & {"language", "toxicity", "line_dedup", "facts", "classes", "labels", "gone"}
    assert held(spark) - before == {os.path.basename(path)}
    shared.drop(spark, path)


def test_workers_get_bounded_batches(spark):
    rows = spark.range(3000).selectExpr("id", "repeat('x', 5000) as text").repartition(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    assert max(r.n for r in shared.bounded(rows).mapInArrow(sizes, "n long").collect()) <= 1.1 * shared.BATCH_BYTES


def test_work_arrays_cover_little_text():
    column = pa.array([" ".join(f"w{k}x{j}" for j in range(400)) for k in range(1000)])
    assert column.nbytes > 2 << 20
    tracemalloc.start()
    try:
        assert sum(len(s) for s in neardup._sets(column)) == 1000 * 396
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
    finally:
        tracemalloc.stop()


def test_workers_give_freed_memory_back():
    def own():
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) >> 10

    def run(batches):
        held = [np.ones(12_000) for _ in range(1000)]
        kept.extend(held[::50])  # what stays keeps the C library from giving back what is freed around it
        yield from batches

    kept, before = [], own()
    assert list(shared.released(run)(iter([1, 2]))) == [1, 2]
    assert own() - before < 40
