"""Line dedup by site-relative frequency, in DataFrame functions alone.

Method.  Pages are grouped by host.  For each line of a host the share of its pages that hold
the line is taken; lines above ``RATIO`` of the pages, and on at least ``LEAST`` of them, are boilerplate
and go from every page of that host.  Pages of one host with the same text count once, in
both numbers, so copies of a page do not turn its lines into boilerplate.  Lines are compared without
blanks at their ends; lines without other characters always stay.

Scale.  Only hashes are shuffled: (host, line, text) once, then counts, with partial
aggregation before each shuffle, so a hot host or line is summed where it lies.  A host has at most
(lines a page) / RATIO boilerplate lines, as each fills that share of its pages.  The table of
them is written and measured: up to ``BROADCAST_BYTES`` it is broadcast, and the texts never move; beyond that,
(row, line) hashes are joined with it and the few hits joined back.

Edge cases.  A null host is a host of its own.  Null text stays null; a text whose every line goes
becomes empty; rows are never dropped, repeated rows are cleaned alike.  An empty table gives no rows.  All columns pass
through, also those with names that this module uses inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

RATIO, LEAST = 0.02, 5
BROADCAST_BYTES = 8 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """Distinct hashes of the lines that hold more than blanks."""
    return F.array_distinct(F.transform(F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """__line_host and __line_common, the hashes of its boilerplate lines, for hosts that have any.  Needs __line_host and text."""
    pages = pages.where(F.col("text").isNotNull()).select("__line_host", F.xxhash64("text", F.length("text")).alias("page"), "text")
    total = pages.select("__line_host", "page").distinct().groupBy("__line_host").agg(F.count(F.lit(1)).alias("pages"))
    held = pages.select("__line_host", "page", F.explode(_hashes(F.col("text"))).alias("line")).distinct().groupBy("__line_host", "line").agg(F.count(F.lit(1)).alias("n"))
    common = held.where(F.col("n") >= least).join(total, "__line_host").where(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("__line_host").agg(F.collect_list("line").alias("__line_common"))


def clean(rows: DataFrame, host: Column, ratio: float = RATIO, least: int = LEAST, broadcast_bytes: int = BROADCAST_BYTES, count: bool = False) -> DataFrame:
    """The rows with boilerplate lines gone from ``text``; with ``count``, also n_lines and n_dropped."""
    spark, names = rows.sparkSession, rows.columns
    aside = {c: f"_{k}" for k, c in enumerate(names) if c != "text"}
    host = host.alias("__line_host")
    rows = rows.select("text", *(F.col(f"`{c}`").alias(a) for c, a in aside.items()), host)
    hosted = rows.withColumn("__line_host", F.coalesce(F.concat(F.lit("h"), F.col("__line_host").cast("string")), F.lit("")))
    common, path = shared.written(boilerplate(hosted.select("__line_host", "text"), ratio, least), "lines")
    if shared.size(spark, path) <= broadcast_bytes:
        found = hosted.join(F.broadcast(common), "__line_host", "left")
    else:
        hosted = hosted.withColumn("__line_row", F.xxhash64("text"))
        lines = hosted.select("__line_host", "__line_row", F.explode(_hashes(F.col("text"))).alias("__line")).distinct()
        hits = lines.join(common.select("__line_host", F.explode("__line_common").alias("__line")), ["__line_host", "__line"])
        hits = hits.groupBy("__line_host", "__line_row").agg(F.collect_list("__line").alias("__line_common"))
        found = hosted.join(hits, ["__line_host", "__line_row"], "left")
    # the page's own boilerplate first, by hashes of both sides: no line is looked up in a list as long as its host's
    hits = F.array_intersect(_hashes(F.col("text")), F.col("__line_common"))
    drop = lambda x, h: F.array_contains(h, F.xxhash64(F.trim(x))) & (F.trim(x) != "")
    kept = F.transform(F.array(hits), lambda h: F.filter(_lines(F.col("text")), lambda x: ~drop(x, h)))[0]  # evaluated once a row
    found = found.withColumn("__line_kept", F.when(F.col("__line_common").isNotNull(), kept))
    text = F.when(F.col("__line_common").isNull(), F.col("text")).otherwise(F.array_join("__line_kept", "\n"))
    out = [text.alias("text") if c == "text" else F.col(aside[c]).alias(c) for c in names]
    if count:
        size = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0))
        out += [size.cast("long").alias("n_lines"), F.when(F.col("__line_common").isNull() | F.col("text").isNull(), 0).otherwise(size - F.size("__line_kept")).cast("long").alias("n_dropped")]
    return found.select(*out)


#: The same over ``documents`` with its source as the host, for DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
pages AS (SELECT source, count(DISTINCT text) AS pages FROM d WHERE text IS NOT NULL GROUP BY source),
held AS (SELECT source, trim(l, ' ') AS line, count(DISTINCT text) AS n
         FROM (SELECT source, text, unnest(ls) AS l FROM d) WHERE trim(l, ' ') <> '' GROUP BY 1, 2),
common AS (SELECT h.source, list(h.line) AS bad FROM held h JOIN pages p ON h.source IS NOT DISTINCT FROM p.source
           WHERE h.n >= {LEAST} AND h.n > {RATIO} * p.pages GROUP BY h.source),
x AS (SELECT d.doc_id, d.text, d.ls, coalesce(c.bad, []) AS bad FROM d LEFT JOIN common c ON d.source IS NOT DISTINCT FROM c.source),
y AS (SELECT doc_id, text, ls, list_filter(ls, lambda l: NOT list_contains(bad, trim(l, ' '))) AS kept FROM x)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped,
       length(array_to_string(kept, chr(10)))::BIGINT AS n_chars, md5(array_to_string(kept, chr(10))) AS text_md5
FROM y
"""
