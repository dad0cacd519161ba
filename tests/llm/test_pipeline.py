"""The pipeline and the queries over whole small tables."""

import os
from collections import Counter

import duckdb
import pytest
from helpers import DOCUMENTS, LABELS, corpus, odd_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from matchloom.llm import neardup
from matchloom.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_stages(spark, tmp_path):
    rows, labels = corpus(200)
    rows += [(1000 + k, rows[3][1], "en", "s0", 0) for k in range(3)] + [(2000, None, None, None, None), (2001, "1234 !!", "en", "s1", 7)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "line_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    toxic = {k for k, _, t in labels if t}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns and docs.schema == before.schema
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language":
            assert not ids & {2000, 2001}
        if name == "toxicity":
            assert len(ids & toxic) <= 3
        if name == "near_dedup":
            assert not ids & {1000, 1001, 1002}
            assert ids == {r.doc_id for r in neardup.groups(before).where("kept").collect()}
    assert {r.doc_id for r in docs.collect()} == ids
    whole = {tuple(r[:5]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {tuple(r[:5]) for r in docs.collect()}


def test_stages_on_odd_and_empty_rows(spark, tmp_path):
    rows = odd_rows(spark, "seen string")
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    everything = sorted(tuple(r) for r in rows.select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("null"))).collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        assert stage(spark, rows.limit(0), str(tmp_path)).collect() == []
        if name == "packing":
            assert Counter((r.doc_id,) for r in out.where("piece = 0").select("doc_id").collect()) == Counter((r.doc_id,) for r in rows.select("doc_id").collect())
            continue
        left = sorted(tuple(r) for r in out.select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("null"))).collect())
        if name == "language":  # one language is known here, and all texts with a letter are in it
            assert left == [x for x in everything if x[1] != "null" and any(map(str.isalpha, x[1]))]
        elif name == "near_dedup":  # rows that repeat an id and text go, nothing else is alike
            assert left == sorted([x for x in everything if x[0] < 0] + list({x for x in everything if x[0] >= 0}))
        else:
            assert left == everything


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DATA)
    rows = found.collect()
    assert rows and name in entry_points.queries()
    if name in ORACLE:
        connection = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        asked = connection.execute(ORACLE[name])
        names = [d[0] for d in asked.description]
        assert sorted(names) == sorted(found.columns)
        assert Counter(tuple(r[n] for n in names) for r in rows) == Counter(asked.fetchall())


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in entry_points.queries()
