"""Brute-force versions and awkward rows shared by the tests."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, `_text` string, node int"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def grams(text, n=5):
    w = words(text)
    if not w:
        return frozenset([("", text)]) if text else frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_docs(spark, more=()):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    rng = random.Random(7)
    base = sentence(rng, 60)
    texts = [None, "", " \n", "!!! ???", "One", "one", "É é ß 漢字 😀", base, base, base.upper(), base + " tail",
             sentence(rng, 30000), "\x00\x1f", *more]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), "big", "x", 1) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
             (8, "another text under one id", "en", "s0", 5, "", "", 2)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
