"""Language ID by compression with one zstandard dictionary a language.

Method.  For each language a bounded sample of texts, cleaned to letters and single
blanks, becomes a raw-content dictionary.  A text is cleaned alike, cut into segments of a
few KB, and each segment is encoded with every dictionary; the language with the fewest
bytes in all wins.  The score is a confidence from the margin to the runner-up, and
``keep_known`` rejects texts whose margin is narrow.

Scale.  Dictionaries hold at most ``DICTIONARY_BYTES`` each and the sample is sized by one
aggregate over two narrow columns.  Every language with a text to learn from gets a dictionary.  Up to ``GROUP`` languages are learned from one
sample and told in one map pass over the whole texts.  More go in groups, the most frequent first: the driver holds the sample of one group
(128 MB of text) and all dictionaries (48 KB a language), a worker the dictionaries of one group, and each group is a pass that
keeps the smallest and the second smallest size so far with each row, in a table of the shared folder.  The result is that of all dictionaries at once.

Edge cases.  Null text, and text without a letter (digits, marks and other numerals are none), give ``und`` and score 0.  A null id is never
held out and never learned from.  Ties go to the more frequent language, then to the one that sorts first.  With
nothing to learn from, every text is ``und``.  Repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled, shared

UNKNOWN = "und"
DICTIONARY_BYTES = 48 << 10
SAMPLE_ROWS, SAMPLE_BYTES = 400, 2 << 20
#: Bytes of a text that go into a dictionary in one piece, at least.
WINDOW = 96
#: Languages whose sample the driver, and whose dictionaries a worker, holds at a time.
GROUP = 64
SEGMENT_BYTES = 2 << 10
LEVEL = 6
#: A margin of this share of the best size counts as certain.
CERTAIN = 0.08

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def clean(text: str) -> bytes:
    """Letters and numerals but digits, lowered, in words with one blank between them."""
    return _NOT_LETTERS.sub(" ", text).strip().lower().encode("utf-8", "surrogatepass")


def shared_lines(texts: list[str]) -> set[str]:
    """Lines that more than one text holds: notices and menus, often in another language."""
    count = Counter(line for text in dict.fromkeys(texts) for line in set(text.split("\n")))
    return {line for line, n in count.items() if n > 1}


def own_lines(texts: list[str], common: set[str]) -> list[str]:
    """The texts without those lines; a text of nothing else stays as it is."""
    return ["\n".join(line for line in text.split("\n") if line not in common) or text for text in texts]


def dictionary(texts: list[str], limit: int = DICTIONARY_BYTES, common: set[str] = frozenset()) -> bytes:
    """Raw content: pieces of the texts by turns, one of each text before the second of any, spread over the whole of each."""
    cleaned = [c for c in dict.fromkeys(map(clean, own_lines(texts, common))) if c]
    share = max(WINDOW, limit // max(1, len(cleaned)))
    out, size, turn, more = [], 0, 0, True
    while more and size < limit:
        more = False
        for c in cleaned:
            n = -(-len(c) // share)
            if turn < n and size < limit:
                at = (turn * 7919 + len(c)) % n * share
                out.append(c[at : at + share])
                size += len(out[-1]) + 1
                more = True
        turn += 1
    return b"\n".join(out)[:limit].ljust(8, b"\n")  # the least that the library takes


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, raw in dictionaries:
        content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


Dictionaries = tuple[tuple[str, bytes], ...]
#: The smallest size of a text so far, the place of its dictionary, and the second smallest size.
Lead = tuple[int | None, int | None, int | None]


def race(text: str | None, group: Dictionaries, at: int = 0, before: Lead = (None, None, None)) -> Lead:
    """The lead after the dictionaries of a group, whose first has the place ``at``; a text without a letter takes no part."""
    if not text or not any(map(str.isalpha, text)):
        return before
    body = clean(text)
    cut = [body[k : k + SEGMENT_BYTES] for k in range(0, len(body), SEGMENT_BYTES)]
    first, place, second = before
    for k, compressor in enumerate(_compressors(group)):
        size = sum(len(compressor.compress(part)) for part in cut)
        if first is None or size < first:
            first, place, second = size, at + k, first
        elif second is None or size < second:
            second = size
    return first, place, second


def told(lead: Lead, languages: list[str]) -> tuple[str, float, float]:
    """Language, score, and the margin as a share of the best size."""
    first, place, second = lead
    if first is None:
        return UNKNOWN, 0.0, 0.0
    if second is None:
        return languages[place], 1.0, 1.0
    margin = (second - first) / first
    return languages[place], min(1.0, 0.5 + 0.5 * margin / CERTAIN), margin


def fit(documents: DataFrame, folds: int = 4, held: int = 2) -> Dictionaries:
    """One dictionary for each language of the documents outside the held-out fold, the most frequent language first.

    Lines that several texts of a group's sample hold are left out of its dictionaries."""
    known = documents.select("doc_id", "lang").where((labelled.fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull())
    ranked = [r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    out: list[tuple[str, bytes]] = []
    for at in range(0, len(ranked), GROUP):
        group = ranked[at : at + GROUP]
        texts: dict[str, list[str]] = {}
        rows = labelled.sample(documents, known if len(ranked) <= GROUP else known.where(F.col("lang").isin(group)), "lang", SAMPLE_ROWS, SAMPLE_BYTES)
        for lang, text in zip(rows["lang"].to_pylist(), rows["text"].to_pylist()):
            texts.setdefault(lang, []).append(text)
        common = shared_lines([t for own in texts.values() for t in own])
        out += [(lang, dictionary(texts[lang], common=common)) for lang in group if lang in texts]
    return tuple(out)


def _raced(documents: DataFrame, dictionaries: Dictionaries) -> tuple[DataFrame, int]:
    """The documents after all groups of dictionaries but the last, and the place where that one starts.

    If there is more than one group, each row has its lead in three more columns, the last ones."""
    names, at, path = documents.schema.names, 0, None
    text = names.index("text")
    extra = ["_size", "_place", "_next"]
    while set(extra) & set(names):
        extra = [f"_{x}" for x in extra]
    rows = documents
    while at + GROUP < len(dictionaries):
        rows = rows.mapInArrow(_lap(dictionaries[at : at + GROUP], at, text, names + extra), _with_lead(documents, extra))
        rows, written = shared.written(rows, "languages")
        if path:
            shared.drop(documents.sparkSession, path)
        at, path = at + GROUP, written
    return rows, at


def _with_lead(documents: DataFrame, extra: list[str]) -> T.StructType:
    return T.StructType([*documents.schema.fields, *(T.StructField(x, T.LongType()) for x in extra)])


def _leads(batch: pa.RecordBatch, text: int, group: Dictionaries, at: int) -> list[Lead]:
    """The lead of each row; rows that come from another group have theirs in the last three columns."""
    before = list(zip(*(c.to_pylist() for c in batch.columns[-3:]))) if at else [(None, None, None)] * batch.num_rows
    return [race(x.as_py(), group, at, lead) for x, lead in zip(batch.column(text), before)]


def _lap(group: Dictionaries, at: int, text: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass of one group: every row with its new lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _leads(batch, text, group, at)
            own = batch.columns[:-3] if at else batch.columns
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([lead[k] for lead in found], pa.int64()) for k in range(3))], names)

    return shared.released(run)


def identify(documents: DataFrame, dictionaries: Dictionaries, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    rows, at = _raced(shared.bounded(documents).select("doc_id", "text"), dictionaries)
    languages, group = [lang for lang, _ in dictionaries], dictionaries[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [told(lead, languages) for lead in _leads(batch, 1, group, at)]
            ids = batch.column(0)
            held_out = pa.array([x == held for x in labelled.folds_of(ids, folds)], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, held_out, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(shared.released(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(documents: DataFrame, dictionaries: Dictionaries, margin: float = 0.002) -> DataFrame:
    """The rows, with all their columns, whose language is told by at least ``margin``."""
    text = documents.schema.names.index("text")
    rows, at = _raced(shared.bounded(documents), dictionaries)
    languages, group = [lang for lang, _ in dictionaries], dictionaries[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [told(lead, languages) for lead in _leads(batch, text, group, at)]
            kept = batch.filter(pa.array([lang != UNKNOWN and m >= margin for lang, _, m in found], pa.bool_()))
            yield kept.select(list(range(batch.num_columns - 3))) if at else kept

    return rows.mapInArrow(shared.released(run), documents.schema)
