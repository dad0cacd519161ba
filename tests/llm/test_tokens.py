"""Exact round trips with the libraries, and packing against its bounds."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from helpers import DOCUMENTS, ODD_TEXTS, corpus, odd_rows
from pyspark.sql import functions as F

from matchloom.llm import packing, pieces

MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "\n", "\n\n a", "a  b   c", "\x00x", "▁", "▁▁a ▁b", "é ① ﬁ 漢字 😀", "<s> </s> <0x0A>", "a" * 70, "\t\t x", " lead", "trail ", "\r\n", "A" * 33 + " " * 40 + "b", "<|endoftext|>x"]


def mixtures(n, seed):
    rng = random.Random(seed)
    parts = ["a", "e", "th", "in", " ", "  ", "\n", "é", "ß", "1", "23", ".", "##", "'s", "the", "▁", "漢", "😀", "S", "ll", "==", "\t", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_pieces_like_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.codec(MODEL)
    for text in ODD + mixtures(3000, 1) + [r[1] for r in corpus(60)[0]]:
        ids = library.encode(text)
        assert list(struct.unpack(f"<{len(ids)}I", own.encode(text))) == ids, repr(text)
        full = [1, *ids, 2]
        assert own.decode(full) == library.decode(full)
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)


def test_pieces_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = pieces.round_trip(odd_rows(spark), MODEL).collect()
    assert len(out) == len(ODD_TEXTS) + 4
    texts = {k: t or "" for k, t in enumerate(ODD_TEXTS)}
    for r in out:
        if r.doc_id is not None:
            ids = [1, *library.encode(texts[r.doc_id]), 2]
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.round_trip(spark.createDataFrame([], DOCUMENTS), MODEL).collect() == []


def test_encoder_like_the_library():
    plain = tokenizers.Tokenizer.from_file(VOCABULARY)
    own = packing.Encoder(VOCABULARY)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added and own.encode(added[0]).tolist() == [plain.token_to_id(added[0])]
    marked = [f"hello {t} world" for t in added] + [f"{t}x {t}\n{t}{t}" for t in added] + [t[:-1] for t in added] + [t.upper() for t in added]
    for text in ODD + marked + mixtures(3000, 3) + [" " * 5000 + "x", "y" * 30000]:
        assert own.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:80])


def check_packing(rows, lengths, capacity):
    """Rows (doc, piece, start, length, sequence, offset): whole documents, gapless sequences within capacity."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert {k: sum(r.length for r in v) for k, v in by_doc.items()} == lengths
    for parts in by_doc.values():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == capacity for r in parts[1:])
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, capacity):
    rows = corpus(150)[0] + [(1000 + k, t, "en", "s", 0) for k, t in enumerate(ODD_TEXTS)]
    own = packing.Encoder(VOCABULARY)
    ids = {r[0]: own.encode(r[1] or "").tolist() + [0] for r in rows}
    out = packing.best_fit(spark.createDataFrame(rows, DOCUMENTS).repartition(5), VOCABULARY, capacity).collect()
    used = check_packing(out, {k: len(v) for k, v in ids.items()}, capacity)
    bound = -(-sum(map(len, ids.values())) // capacity)
    assert bound <= used <= bound * 1.05 + 1
    for r in out:
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.doc_id][r.start : r.start + r.length]))


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def test_matched_brackets():
    rng = random.Random(4)
    for _ in range(200):
        brackets = [rng.choice([1, 1, -1]) for _ in range(rng.randint(1, 60))]
        stack, pairs = [], set()
        for k, b in enumerate(brackets):
            if b > 0:
                stack.append(k)
            elif stack:
                pairs.add((k, stack.pop()))
        assert set(zip(*(x.tolist() for x in packing.matched(np.array(brackets))))) == pairs


LENGTHS = {
    "any": lambda rng: rng.randint(1, 50), "short": lambda rng: rng.randint(1, 12), "long": lambda rng: rng.randint(20, 50), "same": lambda rng: 17, "two": lambda rng: rng.choice([34, 15]),
    "whole": lambda rng: rng.choice([50, 49, 1]), "mixed": lambda rng: rng.choice([rng.randint(1, 50), rng.randint(1, 6), 17]),
}


@pytest.mark.parametrize(("kind", "task_rows"), [*((kind, 40) for kind in sorted(LENGTHS)), ("mixed", 1 << 18)])
def test_packing_is_as_good_as_one_by_one(spark, monkeypatch, kind, task_rows):
    """Against best-fit decreasing, piece by piece; with small tasks, most matches are between ranges."""
    monkeypatch.setattr(packing, "TASK_ROWS", task_rows)
    rng = random.Random(kind)
    lengths = [LENGTHS[kind](rng) for _ in range(600)]
    rows = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long").repartition(3)
    by_sequence = {}
    out = packing.pack(rows, 50).collect()
    assert sorted((r.doc_id, r.length) for r in out) == list(enumerate(lengths))
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 50
    best = best_fit_decreasing(lengths, 50)
    assert len(by_sequence) <= best + 1


def test_wide_gaps_are_spread_over_the_ranges(spark):
    """200 gaps for 204 pieces each beside as many short pieces, in 7 ranges: no range is much heavier than another."""
    todo = spark.range(40_800).select(F.struct(F.col("id").alias("doc_id"), F.lit(10).alias("length")).alias("p"))
    gaps = spark.range(200).select(F.col("id").alias("sequence"), F.lit(2048).alias("room"))
    dealt = packing._dealt(todo, gaps, 1, 10, 7)
    held = [r[0] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("n")).select("sum(n)").collect()]
    assert sum(held) == 2 * 40_800 + 200 and max(held) < 1.7 * sum(held) / 7


def test_packing_many_copies_odd_rows_and_clashes(spark):
    same = spark.createDataFrame([(k, "the same text again", "en", "s", 1) for k in range(500)], DOCUMENTS).repartition(3)
    out = packing.best_fit(same, VOCABULARY, 64).collect()
    n = out[0].length
    assert len(out) == 500 and len({r.sequence_id for r in out}) == -(-500 // (64 // n))
    assert packing.best_fit(odd_rows(spark), VOCABULARY).select("offset").count() >= len(ODD_TEXTS) + 4
    assert packing.best_fit(same.limit(0), VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 2)], "length long, offset long"))
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(65,), (1,)], "length long"), 64)


def test_ids_come_along(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    r = packing.pack(packing.cut(docs, VOCABULARY, with_ids=True)).first()
    assert r.ids == packing.Encoder(VOCABULARY).encode("some words here").tolist() + [0] and r.offset == 0
