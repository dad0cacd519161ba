"""Small documents for the text operators."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"

_SYLLABLES = {"en": "the ing on er wh and th st ly re of".split(), "de": "sch ung ein ver zu ß keit lich ö ge".split(), "fr": "eau ré oi ment é çe que ou le".split()}


def word(rng, lang):
    return "".join(rng.choice(_SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))


def text(rng, lang="en", n=40):
    return " ".join(word(rng, lang) for _ in range(n)).capitalize() + "."


def corpus(n=240, seed=7):
    """Documents (in all languages) and labels: every fifth is shouted junk, every seventh has an insult."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(list(_SYLLABLES))
        body = text(rng, lang, rng.randint(15, 60))
        bad, toxic = k % 5 == 0, k % 7 == 0
        if toxic:
            parts = body.split(" ")
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(["idiot", "moron", "scum"]))
            body = " ".join(parts)
        if bad:
            body = body.replace(" ", "### ").upper()
        rows.append((k, body, lang, f"s{k % 3}", len(body)))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


ODD_TEXTS = [None, "", " ", "\n\n", "x", "é\x00é", "a " * 3000, "漢字 and 😀", "word" * 5000]


def odd_rows(spark, more="x string"):
    """Odd texts, repeated rows, nulls in every column, and a column that no operator knows."""
    rows = [(k, t, None if k % 2 else "en", None if k % 3 else "s", None, "extra") for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[6], (None, "no id at all here", "en", "s", 3, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, f"{DOCUMENTS}, {more}")
