"""Classifiers: held-out accuracy, brute-force counts, edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOCUMENTS, LABELS, ODD_TEXTS, corpus, odd_rows

import zstandard
from matchloom.llm import columnar, labelled, langid, nbsvm, rules, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, LABELS), dict((r[0], r) for r in rows), dict((r[0], r) for r in labels)


def is_held(k, n, r):
    return zlib.crc32(str(k).encode()) % n == r


@pytest.mark.parametrize(("module", "column", "threshold"), [(nbsvm, 1, 0.3), (toxicity, 2, 0.5)])
def test_held_out_accuracy(spark, tables, module, column, threshold):
    docs, labels, _, truth = tables
    out = module.score(docs, module.fit(docs, labels)).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == is_held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][column] for r in held]) >= 0.9


@pytest.mark.parametrize("module", [nbsvm, toxicity])
def test_held_out_labels_are_not_used(spark, tables, module):
    docs, labels, _, _ = tables
    lies = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) as quality", "if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert sorted(module.score(docs, module.fit(docs, labels)).collect()) == sorted(module.score(docs, module.fit(docs, lies)).collect())


@pytest.mark.parametrize("module", [nbsvm, toxicity])
def test_scores_of_odd_rows_and_empty_tables(spark, tables, module):
    docs, labels, _, _ = tables
    model = module.fit(docs, labels)
    out = module.score(odd_rows(spark), model).collect()
    assert len(out) == len(ODD_TEXTS) + 4 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (0, 1)}) == 1  # null reads as empty
    assert not any(r.held_out for r in out if r.doc_id is None)
    assert module.score(docs.limit(0), model).collect() == []
    blank = module.fit(docs, labels.limit(0))
    assert {0 <= r.score <= 1 for r in module.score(docs, blank).collect()} == {True}
    assert module.fit(docs.limit(0), labels) is not None


def test_toxic_rows_go_with_their_columns(spark, tables):
    docs, labels, _, truth = tables
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, labels))
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    clean = {k for k, r in truth.items() if not r[2]}
    assert len(clean & ids) >= 0.95 * len(clean) and len(ids - clean) <= 0.1 * len(truth)


def test_language(spark, tables):
    docs, _, rows, _ = tables
    dictionaries = langid.fit(docs)
    assert {d[0] for d in dictionaries} == {"en", "de", "fr"}
    out = langid.identify(docs, dictionaries).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == is_held(r.doc_id, 4, 2) for r in out)
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) >= 0.95
    odd = {r.doc_id: r for r in langid.identify(odd_rows(spark), dictionaries).collect()}
    assert [odd[k].lang_pred for k in (0, 1, 2, 3)] == ["und"] * 4 and odd[0].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values())
    kept = langid.keep_known(docs, dictionaries)
    assert kept.schema == docs.schema and kept.count() >= 0.97 * len(rows)
    assert langid.keep_known(odd_rows(spark), dictionaries).where("text is null or trim(text) = ''").count() == 0


def test_language_without_anything_to_learn(spark, tables):
    docs = tables[0]
    assert langid.fit(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")) == ()
    assert {r.lang_pred for r in langid.identify(docs, ()).collect()} == {"und"}
    assert langid.identify(docs.limit(0), ()).collect() == []


def test_language_does_not_learn_from_held_out_rows(spark, tables):
    docs = tables[0]
    lies = docs.selectExpr("doc_id", "if(crc32(string(doc_id)) % 4 = 2, 'junk', text) as text", "if(crc32(string(doc_id)) % 4 = 2, 'xx', lang) as lang")
    assert langid.fit(docs) == langid.fit(lies)


def brute_counts(value):
    words = re.findall(r"[^\x20\x09-\x0D]+", value or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (value or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", value or "")), dup, len(covered)]


def test_base_counts_like_brute_force(spark):
    rng = np.random.default_rng(1)
    pieces = ["a", "b", "c d", "\n", " ", "\t", "é", "##", "<x>", "a b c d e\n", "\r\n", "漢"]
    texts = ODD_TEXTS + ["".join(rng.choice(pieces, size=rng.integers(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in rules.judge(df, rules.Forest.fit(np.zeros((0, len(rules.FEATURES))), np.zeros(0))).collect()}
    for k, t in enumerate(texts):
        r = out[k]
        counts = brute_counts(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts, repr(t)[:200]
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert r.kept == (not r.base_failed)  # nothing was learned


def test_forest(spark, tables):
    docs, labels, _, truth = tables
    forest = rules.fit(docs, labels)
    out = rules.judge(docs, forest).collect()
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id][1]) for r in out]) >= 0.95
    assert not any(r.kept and r.base_failed for r in out)
    assert rules.judge(odd_rows(spark), forest).count() == len(ODD_TEXTS) + 4
    assert rules.judge(docs.limit(0), forest).collect() == []


def test_forest_is_monotonic():
    rng = np.random.default_rng(4)
    x = rng.random((600, len(rules.FEATURES))).astype(np.float32)
    y = (x[:, 2] + 0.3 * np.sin(9 * x[:, 5]) + 0.2 * rng.random(600) > 0.7).astype(float)  # rises where it must not
    forest = rules.Forest.fit(x, y)
    for name in rules.FALLING:
        k = rules.FEATURES.index(name)
        for row in x[:20]:
            grid = np.repeat(row[None], 50, 0)
            grid[:, k] = np.linspace(0, 1, 50)
            assert (np.diff(forest.scores(grid)) <= 1e-12).all()


def test_block_borders_do_not_matter(monkeypatch):
    rows, _ = corpus(40)
    data = np.frombuffer("".join(r[1] for r in rows).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(r[1].encode()) for r in rows])))
    whole = rules.statistics(data, offsets)
    monkeypatch.setattr(rules.columnar, "blocks", lambda o: columnar_blocks(o, 100))
    parts = rules.statistics(data, offsets)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


columnar_blocks = columnar.blocks


def utf8(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def test_language_like_sizes_one_by_one(spark, tables):
    docs, _, rows, _ = tables
    dictionaries = langid.fit(docs)
    out = {r.doc_id: r for r in langid.identify(docs, dictionaries).collect()}
    for k, r in list(rows.items())[:60]:
        words = re.findall(r"[^\W\d_]+", r[1].lower())
        body = " ".join(words).encode()
        sizes = []
        for _, raw in dictionaries:
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=langid.LEVEL)
            total = 0
            for at in range(0, len(body), langid.SEGMENT_BYTES):
                total += len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress(body[at : at + langid.SEGMENT_BYTES]))
            sizes.append(total)
        assert out[k].lang_pred == dictionaries[sizes.index(min(sizes))][0]


def test_texts_without_a_letter_are_unknown(spark, tables):
    dictionaries = langid.fit(tables[0])
    odd = ["½ ²", "①", "１２", "12 _ 3", "\u0301", "...", "漢", "ª", "x½"]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), dictionaries).collect()}
    assert [(out[k].lang_pred == "und", out[k].score == 0) for k in range(len(odd))] == [(True, True)] * 6 + [(False, False)] * 3


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(k, f"word{chr(97 + k % 26)} " * 9, f"l{k}") for k in range(300)] + [(1000, "12", "digits"), (1001, None, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {f"l{k}" for k in range(300) if not is_held(k, 4, 2)}
    assert {lang for lang, raw in langid.fit(docs) if len(raw) >= 8} - {"digits"} == known


def test_languages_in_groups(spark, monkeypatch):
    """Groups of dictionaries one after another give what all at once give, ties and texts without letters included."""
    rng = random.Random(3)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 7))) for _ in range(40)] for k in range(11)}
    rows = [(k, " ".join(rng.choices(words[f"l{k % 11}"], k=30)), f"l{k % 11}", k) for k in range(330)]
    rows += [(400 + k, x, None, None) for k, x in enumerate([None, "", "12", "a", "a a", " ".join(words["l0"] + words["l1"])])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _size long")
    at_once = langid.fit(docs)
    assert len(at_once) == 11
    one = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in langid.identify(docs, at_once).collect()}
    kept = sorted(r.doc_id for r in langid.keep_known(docs, at_once).collect())
    for size in (1, 4, 10):
        monkeypatch.setattr(langid, "GROUP", size)
        assert langid.fit(docs) == at_once  # no line is in two texts here
        assert {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in langid.identify(docs, at_once).collect()} == one
        some = langid.keep_known(docs, at_once)
        assert some.schema == docs.schema and sorted(r.doc_id for r in some.collect()) == kept
    assert langid.identify(docs.limit(0), at_once).collect() == []


def test_dictionary_holds_pieces_of_all_texts():
    texts = [f"{chr(97 + k)}{chr(98 + k)} " * 2000 for k in range(20)]
    raw = langid.dictionary(texts, 4000)
    assert 3900 <= len(raw) <= 4000 and all(f"{chr(97 + k)}{chr(98 + k)}".encode() in raw for k in range(20))
    assert langid.dictionary([]) == b"\n" * 8


def test_descent_reaches_the_optimum(monkeypatch):
    """Against projected gradients of the dual, on a small problem: both objectives meet."""
    monkeypatch.setattr(nbsvm.QualityModel, "ROUNDS", 400)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, 12)) for _ in range(30)]
    labels = np.array([int(s.min() < 3) for s in sets])
    ratio = nbsvm.QualityModel._ratios(sets, labels)
    weights, bias = nbsvm.QualityModel._descend(sets, labels, ratio)
    n, sign = len(sets), np.where(labels > 0, 1.0, -1.0)
    x = np.zeros((n, 41))
    for k, s in enumerate(sets):
        x[k, s] = ratio[s]
        x[k] /= max(1e-9, np.linalg.norm(x[k]))
        x[k, 40] = 1
    cost = np.where(labels > 0, n / (2 * labels.sum()), n / (2 * (n - labels.sum())))
    w = np.append(np.divide(weights[:40], ratio[:40], out=np.zeros(40), where=ratio[:40] != 0), bias)
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    gram = (sign[:, None] * x) @ (sign[:, None] * x).T
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    dual = alpha.sum() - 0.5 * alpha @ gram @ alpha
    assert dual - 1e-6 <= primal <= 1.02 * dual


def test_online_learning_like_plain_loops(monkeypatch):
    """From the texts on, row by row, in dictionaries; words of a single row and rows that are long learned count like all."""
    monkeypatch.setattr(toxicity.ToxicityModel, "L1", 0.02)
    model = toxicity.ToxicityModel
    rng = np.random.default_rng(2)
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 50, 10)), f"once{k}", *(["vile"] if k % 3 == 0 else [])]) for k in range(40)]
    labels = np.array([int(k % 3 == 0) for k in range(40)])
    data, offsets = utf8(texts)
    sets = [sorted(set(toxicity.features(*utf8([t]))[0].tolist())) for t in texts]
    found = model.fit(data, offsets, labels)
    z, squares, bias, bias_squares, smallest = {}, {}, 0.0, 1.0, 1.0
    weight = (40 / (2 * (40 - labels.sum())), 40 / (2 * labels.sum()))

    def w(x):
        if abs(z.get(x, 0.0)) <= model.L1:
            return 0.0
        return (np.sign(z[x]) * model.L1 - z[x]) / ((model.BETA + np.sqrt(squares[x])) / model.RATE + model.L2)

    order = np.random.default_rng(11)
    for _ in range(model.ROUNDS):
        for k in order.permutation(np.arange(40)):
            now = {x: w(x) for x in sets[k]}
            g = (1 / (1 + np.exp(-(sum(now.values()) + bias))) - labels[k]) * weight[labels[k]]
            smallest = min(smallest, abs(g))
            for x in sets[k]:
                old = squares.get(x, 0.0)
                squares[x] = old + g * g
                z[x] = z.get(x, 0.0) + g - (np.sqrt(squares[x]) - np.sqrt(old)) / model.RATE * now[x]
            bias_squares += g * g
            bias -= g * model.RATE / np.sqrt(bias_squares)
    single = {x for x in set().union(*sets) if sum(x in s for s in sets) == 1}
    assert {int(i): float(v) for i, v in zip(found.index, found.weights)} == pytest.approx({x: w(x) for x in sorted(z) if w(x)}, rel=1e-5)
    assert found.bias == pytest.approx(bias) and smallest < 1e-3 and single & set(found.index.tolist())


def test_forest_scores_like_one_walk_a_row(spark, tables):
    docs, labels, rows, _ = tables
    forest = rules.fit(docs, labels)
    texts = [r[1] for r in list(rows.values())[:50]]
    _, x = rules.statistics(*utf8(texts))

    def walk(row):
        total = forest.bias
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return 1 / (1 + np.exp(-total))

    assert forest.scores(x).tolist() == pytest.approx([walk(r) for r in x])


def test_labelled_rows_are_bounded(spark):
    """Ids that repeat with other texts are as many rows, equal rows count once."""
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(20)] + [(77, f"x{k}") for k in range(3000)] + [(5, "same")] * 500, "doc_id long, text string").repartition(3)
    strata = spark.createDataFrame([(k, "a") for k in range(20)] + [(77, "a"), (77, "b"), (None, "a"), (3, None)], "doc_id long, s string")
    found = labelled.sample(docs, strata, "s", 100, 1 << 20)
    counts = Counter(found["s"].to_pylist())
    assert 50 <= counts["a"] <= 200 and 50 <= counts["b"] <= 200
    assert len(set(zip(*(found[c].to_pylist() for c in found.column_names)))) == len(found)
    assert found.equals(labelled.sample(docs.repartition(5), strata, "s", 100, 1 << 20))
    assert labelled.sample(docs, strata, "s", 10**6, 1 << 30).num_rows == 2 * 3000 + 21
    assert len(labelled.sample(docs, strata, "s", 10**6, 10_000)) < 6021
