"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

Method.  In BPE every prefix of a text has one last token in its encoding.  An automaton finds the
vocabulary pieces that end at each place; of these the last token is the one that is
compatible with the last token of the prefix before it, where two tokens are compatible if
no merge ever crosses the boundary between them.  Compatibility is told by replaying the
merges at both edges of the boundary in order of rank.  With the table filled, the ids are
read backwards from the end.  The cost is linear in the text.

A piece never holds a blank after another character, and a line feed is in no piece, so the table is built for
runs of blanks with the word after them, and remembered for words that come often.  Memory for
that is bounded by ``CACHE`` entries.

The model file is read with the sentencepiece library (pieces and scores only); its own encoder and
decoder are not used.  Models must be BPE with byte fallback, identity normalisation, a
dummy prefix and no removal of blanks, else an error is raised.

Edge cases.  Null text reads as empty, which encodes to begin and end alone and decodes to the empty text.
Characters outside the vocabulary become their UTF-8 bytes.  Ids and rows repeat as they come;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import shared

BLANK = "▁"
#: Words remembered by each worker, in each of two generations, and their longest length.
CACHE, LONGEST = 120_000, 40
_UNITS = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
_NEVER = 1 << 60


class _Words(dict):
    """Ids (as bytes) of words; when full, only words used since the last time stay."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.codec.encode_unit(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        if "".join(model.encode("  a  ", out_type=str)).replace(BLANK, " ") != "   a  ":
            raise ValueError("the model must add one blank in front and keep all others")
        names = [model.id_to_piece(i) for i in range(size)]
        self.names = names
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        byte = [model.is_byte(i) for i in range(size)]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(size) if byte[i]}
        if len(self.byte_id) != 256:
            raise ValueError("the model must have byte fallback")
        plain = [i for i in range(size) if not special[i] and not byte[i]]
        if any(BLANK in names[i].lstrip(BLANK) or "\n" in names[i] for i in plain):
            raise ValueError("a piece of the model holds a blank after another character, or a line feed")
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = dict(zip(order, range(len(order))))
        self.ids = {names[i]: i for i in plain}
        self._edges()
        self.fits: dict[int, bool] = {}
        self.words = _Words(self)
        self.surface = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if byte[i] else names[i].replace(BLANK, " ").encode() for i in range(size)]
        self.is_byte = byte

    def _edges(self) -> None:
        """For each piece that BPE can make: the tokens at its left and right edge, from the character up, and their ranks."""
        self.left: dict[int, list[int]] = {}
        self.right: dict[int, list[int]] = {}
        automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            merges = self._merge(name)
            if merges is None:
                continue
            self.left[i], self.right[i] = merges
            automaton.add_word(name, (i, len(name)))
        automaton.make_automaton()
        self.automaton = automaton

    def _merge(self, name: str) -> tuple[list[int], list[int]] | None:
        """Plain BPE over one piece, noting the tokens that stand at its two edges; None if it does not end as this piece."""
        parts = list(name)
        if any(c not in self.ids for c in parts):
            return None
        left, right = [self.ids[parts[0]]], [self.ids[parts[-1]]]
        while len(parts) > 1:
            best, at = _NEVER, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(self.ids.get(parts[k] + parts[k + 1], -1), _NEVER)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left.append(self.ids[parts[0]])
            if at == len(parts) - 1:
                right.append(self.ids[parts[-1]])
        return left, right

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the boundary between tokens a and b alone until both are whole."""
        x, y = self.right[a], self.left[b]
        i = j = 0
        rank, names, ids = self.rank, self.names, self.ids
        while True:
            next_x = rank[x[i + 1]] if i + 1 < len(x) else _NEVER
            next_y = rank[y[j + 1]] if j + 1 < len(y) else _NEVER
            joined = ids.get(names[x[i]] + names[y[j]])
            # of equal ranks the merge further left goes first
            if joined is not None and (cross := rank[joined]) < next_x and cross <= next_y:
                return False
            if next_x == next_y == _NEVER:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def encode_unit(self, unit: str) -> bytes:
        """Ids of a run that no merge leaves, as little-endian unsigned 32-bit integers."""
        last: list[int | None] = [None] * len(unit)
        sizes = [1] * len(unit)
        fits = self.fits
        for end, (token, size) in self.automaton.iter(unit):
            if last[end] is None:
                before = end - size
                if before >= 0 and (previous := last[before]) is not None:
                    pair = previous << 32 | token
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) > 2_000_000:
                            fits.clear()
                        ok = fits[pair] = self.compatible(previous, token)
                    if not ok:
                        continue
                last[end], sizes[end] = token, size
        out: list[int] = []
        end = len(unit) - 1
        while end >= 0:
            if (token := last[end]) is None:
                out.extend(self.byte_id[b] for b in reversed(unit[end].encode()))
            else:
                out.append(token)
            end -= sizes[end]
        return struct.pack(f"<{len(out)}I", *reversed(out))

    def encode(self, text: str) -> bytes:
        """Ids of a text without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "  " in text or text[0] == " " or BLANK in text:
            units = _UNITS.findall(BLANK + text.replace(" ", BLANK))
        else:
            units = (BLANK + text.replace(" ", f" {BLANK}").replace("\n", " \n ")).split(" ")
        return b"".join(map(self.words.__getitem__, units))

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        first = next((i for i in ids if surface[i]), None)
        return text[1:] if first is not None and not self.is_byte[first] and text[:1] == " " else text

    def _decode_runs(self, ids: Sequence[int]) -> str:
        out, run = [], b""
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                try:
                    out.append(run.decode())
                    break
                except UnicodeDecodeError as bad:
                    out.append(run[: bad.start].decode() + "�")
                    run = run[bad.start + 1 :]
            run = b""
            if i >= 0:
                out.append(self.surface[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker and file."""
    return Codec(path)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, with begin and end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        begin, end = struct.pack("<I", code.begin), struct.pack("<I", code.end)
        for batch in batches:
            count, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids = b"".join((begin, code.encode(text.as_py() or ""), end))
                count.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(code.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return shared.bounded(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
