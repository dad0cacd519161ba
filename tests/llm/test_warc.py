"""Archives written and read back, whole and damaged."""

import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import queries, shared, warc

PAGES = "page_id long, url string, html string, record_type string"


def expected(rows):
    raw = [(k, (h or "").encode()) for k, _, h, _ in rows]
    lead = {}
    for k, b in raw:
        if len(b) >= 1000:
            lead[b] = max((x for x in (lead.get(b), k) if x is not None), default=None)
    out = []
    for k, b in raw:
        top = lead.get(b)
        first = top is None or top == k
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else top, None))
    return sorted(out, key=repr)


def rows_of(n=120, seed=4):
    rng = random.Random(seed)
    rows = [(k, f"http://a.example/{k}?q=é {k}", "<p>" + "".join(rng.choice("ab\r\né漢 ") for _ in range(rng.randint(0, 6000))) + "WARC/1.1\r\n\r\n0\r\n\r\n", "x") for k in range(n)]
    copies = ["c" * 1000, "é" * 3000, "c" * 999]
    rows += [(1000 + k, None, copies[k % 3], None) for k in range(90)]
    rows += [rows[3], (None, "u\r\nWARC-Type: revisit", "c" * 1000, "x"), (None, None, None, None), (5000, "", "", ""), (5001, "u", "d" * 70_000, ""), (-5, "u", "n" * 2000, ""), (-6, "u", "n" * 2000, "")]
    return rows


@pytest.mark.parametrize(("segment", "limit"), [(4096, 8 << 20), (300, 0)])
def test_round_trip(spark, monkeypatch, segment, limit):
    monkeypatch.setattr(warc, "RECORDS", 50)
    monkeypatch.setattr(warc, "HOT", 3)
    rows = rows_of()
    out = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3), segment, 100, limit)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(rows)


def test_payloads_and_continuations(spark, tmp_path):
    rows = rows_of()
    path = str(tmp_path / "warc")
    warc.write(spark.createDataFrame(rows, PAGES), path, 500, 64)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    for k, _, html, _ in rows:
        if k is not None and got[str(k)].record_type == "response":
            assert bytes(got[str(k)].payload) == (html or "").encode() and got[str(k)].problem is None
    parts = [r for f in (tmp_path / "warc").glob("part*") for r in warc.parse(warc.inflated(f.read_bytes()))]
    assert sum(r[4] == "continuation" for r in parts) > 500 and got["3"].uri == "http://a.example/3?q=%C3%A9%203"
    assert all(len(r[8]) <= 500 for r in parts)


def test_empty_table_and_query(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op13_warc(spark, str(tmp_path)).collect() == []


def archive(*pages, segment=40):
    out = []
    for k, html in pages:
        body = html.encode()
        out += [r + b"\r\n\r\n" for r in warc.records(k, "u", body, hashlib.sha1(body).hexdigest(), False, "2020-01-01T00:00:00Z", segment, 16)]
    return out


def read(spark, tmp_path, name, *files):
    folder = tmp_path / name
    folder.mkdir()
    for k, content in enumerate(files):
        (folder / f"{k}.warc").write_bytes(content)
    return sorted((r.page_id, bytes(r.payload), r.problem) for r in warc.read(spark, str(folder)).collect())


def test_damaged_archives(spark, tmp_path):
    records = archive((1, "first page, quite long " * 3), (2, "second"))
    whole = [("1", ("first page, quite long " * 3).encode(), None), ("2", b"second", None)]
    n = len(records)
    assert read(spark, tmp_path, "whole", b"".join(records)) == whole
    mixed = records[:]
    random.Random(1).shuffle(mixed)
    assert read(spark, tmp_path, "mixed", b"".join(mixed[: n // 2]), gzip.compress(b"".join(mixed[n // 2 :]))) == whole
    assert read(spark, tmp_path, "members", b"".join(map(gzip.compress, records))) == whole
    gap = [r for k, r in enumerate(records) if k != 2]
    assert [r[2] for r in read(spark, tmp_path, "gap", b"".join(gap))] == ["segments", None]
    first = sum(b"X-Page-Id: 2" not in r for r in records[: n - 1])
    last = next(k for k, r in enumerate(records) if b"Segment-Total-Length" in r)
    assert first and [r[2] for r in read(spark, tmp_path, "last", b"".join(r for k, r in enumerate(records) if k != last))] == ["total length", None]
    wrong = [r.replace(b"Total-Length: ", b"Total-Length: 1") for r in records]
    assert {r[2] for r in read(spark, tmp_path, "total", b"".join(wrong))} == {"total length"}
    assert [r[2] for r in read(spark, tmp_path, "digest", b"".join(archive((1, "some text"), segment=4096)).replace(b"some", b"same"))] == ["digest"]
    assert [r[2] for r in read(spark, tmp_path, "chunks", b"".join(archive((1, "some text"), segment=4096)).replace(b"9\r\nsome", b"x\r\nsome"))] == ["chunks"]
    assert [r[2] for r in read(spark, tmp_path, "cut", b"".join(archive((1, "some text"), segment=4096))[:-30])] == ["truncated"]
    assert read(spark, tmp_path, "none", b"", b"no archive", b"\x1f\x8bbroken") == []


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_framing(content, chunk):
    assert warc.unframed(warc.framed(content, chunk)) == (content, True)


def test_framing_of_others():
    assert warc.unframed(b"4;x=y\r\nwiki\r\n0\r\nTrailer: 1\r\n\r\n") == (b"wiki", True)
    assert warc.unframed(b"4\r\nwi") == (b"wi", False) and warc.unframed(b"") == (b"", False)


def test_nothing_is_left_behind(spark):
    import os

    top = shared.folder(spark) + "/matchloom"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    with shared.scope(spark):
        assert warc.round_trip(spark.createDataFrame(rows_of(10), PAGES)).count()
    assert set(os.listdir(top)) == before
