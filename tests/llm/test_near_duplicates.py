"""Near-duplicate groups against brute force, over every path of the join."""

import random
import re

import numpy as np
import pytest
from helpers import DOCUMENTS, ODD_TEXTS, odd_rows, text

import corpus_pipeline
from matchloom.llm import neardup

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(rows):
    out = {}
    for k, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOWER))
        n = min(5, len(words))
        out[k] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def corpus(seed=1):
    """Exact copies, near copies of many grades, chains, and a passage that many texts share."""
    rng = random.Random(seed)
    rows = []

    def add(t):
        rows.append((1000 - len(rows) * 3, t, "en", "s", 0))

    passage = text(rng, n=25)
    for _ in range(60):
        add(text(rng, n=rng.randint(3, 30)) + " " + passage)
    for _ in range(4):
        base = text(rng, n=120).split(" ")
        for k in range(25):
            copy = list(base)
            for _ in range(k % 5):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            add(" ".join(copy))
    chain = text(rng, n=100).split(" ")
    for k in range(15):
        chain[5 * k] = f"c{k}"
        add(" ".join(chain))
    for _ in range(8):
        add("Exactly The SAME text here again")
    for k in range(40):
        add(text(rng, n=rng.randint(1, 8)))
    return rows


def by_id(rows):
    """The same by plain search, where an id may have several texts: {id: least id reachable}."""
    sets = [next(iter(sets_of([r]).values())) for r in rows]
    parent = {r[0]: r[0] for r in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in parent}


def test_repeated_ids(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    four = [(5, a, "en", "s", 0), (5, b, "en", "s", 0), (7, a + " z", "en", "s", 0), (9, b + " z", "en", "s", 0)]
    assert {(r.doc_id, r.component_id, r.kept) for r in neardup.groups(spark.createDataFrame(four, DOCUMENTS)).collect()} == {(5, 5, True), (7, 5, False), (9, 5, False)}
    assert sorted(r.text for r in neardup.keep_one(spark.createDataFrame(four, DOCUMENTS)).collect()) == [a, b]
    rng = random.Random(9)
    rows = [(rng.randrange(150), *r[1:]) for r in corpus(4)] + [(3, a, "en", "s", 0)] * 3 + [(3, None, "en", "s", 0), (3, "", "en", "s", 0)]
    out = neardup.groups(spark.createDataFrame(rows, DOCUMENTS).repartition(4)).collect()
    truth = by_id(rows)
    assert len(out) == len(rows)
    assert all(r.component_id == (truth[r.doc_id] if r.n_shingles else r.doc_id) for r in out)
    kept = neardup.keep_one(spark.createDataFrame(rows, DOCUMENTS).repartition(4)).collect()
    texts = list(dict.fromkeys(r[1] for r in rows))
    group = brute([(k, t) for k, t in enumerate(texts)])
    wordless = {(r[0], r[1]) for r in rows if not sets_of([r])[r[0]]}
    assert len({group[texts.index(r.text)][1] for r in kept if r.text}) == len([r for r in kept if r.text]) == len({g for k, (n, g) in group.items() if n})
    assert {(r.doc_id, r.text) for r in kept if not r.text} == wordless
    first = {}
    for r in rows:
        if r[1]:
            first[group[texts.index(r[1])][1]] = min(first.get(group[texts.index(r[1])][1], r[0]), r[0])
    assert all(r.doc_id == first[group[texts.index(r.text)][1]] for r in kept if r.text)


def run(spark, rows):
    out = neardup.groups(spark.createDataFrame(rows, DOCUMENTS).repartition(4)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


@pytest.mark.parametrize(
    "settings",
    [
        {},
        {"SMALL": 8, "PIVOTS": 2},  # large nodes: chunks, branches, dense nodes
        {"SMALL": 8, "DEPTH": 2, "DENSE": 2.0},  # what is left at the bottom is settled exactly
        {"SMALL": 6, "DENSE": 0.0, "BROADCAST_ROWS": -1},  # all large nodes settled exactly; shuffled joins
    ],
)
def test_like_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(neardup, name, value)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, few):
    rng = random.Random(2)
    pairs = [tuple(sorted(rng.sample(range(300), 2))) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500 + k) for k in range(1, 90)]
    found, _ = neardup.components(spark.createDataFrame(pairs, "a long, b long"), few)
    parent = {}

    def find(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {r.comp: r.least for r in found.collect()} == {k: find(k) for k in parent}
    assert neardup.components(spark.createDataFrame([], "a long, b long"), few)[0].collect() == []


def test_links():
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = rng.integers(1, 1 << 60, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate((base[rng.random(60) < rng.choice([0.5, 0.9, 0.97])], rng.integers(1, 1 << 60, rng.integers(0, 5), dtype=np.uint64)))) for _ in range(rng.integers(2, 12))]
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        assert neardup.links(sets).tolist() == root


def test_exact_border(spark):
    words = [f"w{k}" for k in range(200)]
    one, two = " ".join(words[:104]), " ".join(words[:89])  # 100 and 85 shingles: exactly 85 per cent
    assert run(spark, [(1, one, "", "", 0), (2, two, "", "", 0)])[2] == (85, 1)
    assert run(spark, [(1, one + " x", "", "", 0), (2, two, "", "", 0)])[2] == (85, 2)


def test_odd_rows(spark):
    rows = odd_rows(spark)
    out = neardup.groups(rows).collect()
    assert len(out) == len(ODD_TEXTS) + 4
    empty = [r for r in out if r.n_shingles == 0]
    assert all(r.kept and r.component_id == r.doc_id for r in empty)
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    assert neardup.groups(rows.limit(0)).collect() == []
    kept = neardup.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, k) for k in range(len(ODD_TEXTS))] + [(True, 0)] * 2
    clash = rows.withColumns({"goes": rows["doc_id"], "n": rows["doc_id"], "one": rows["text"], "_1": rows["text"], "_gone_id": rows["text"]})
    assert neardup.keep_one(clash).columns == clash.columns and neardup.keep_one(clash).count() == kept.count()


def test_one_of_each_group_stays(spark):
    rows = corpus(3)
    kept = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert kept == {least for _, least in brute(rows).values()}


def test_percent(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[:n]), "en", "s", 0) for k, n in ((1, 104), (2, 84))]  # 100 and 80 shingles: exactly 80 per cent
    rows += [(k, " ".join(f"v{w}" for w in words[:n]), "en", "s", 0) for k, n in ((3, 104), (4, 83))]  # 79 per cent
    docs = spark.createDataFrame(rows, DOCUMENTS)
    assert {r.doc_id: r.component_id for r in neardup.groups(docs, 80).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id for r in neardup.groups(docs, 85).where("kept").collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 3, 4}
    assert (neardup.trees_for(85), neardup.trees_for(80)) == (6, 7)
