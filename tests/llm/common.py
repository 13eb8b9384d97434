"""Small inputs with the awkward cases every operator must take."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, score string, base string, secrets string, rule string, labels string, component string, held_out string, ids string, _n long, _hit string, _text string, _sums string"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def awkward(spark, texts=()):
    """Null and repeated ids, null and empty texts, ties, a long text, and columns whose names clash with the operators'."""
    rows = [(1, None), (2, ""), (None, "a null id"), (None, None), (3, "same text, twice"), (3, "same text, twice"), (4, "same text, twice"), (3, "same id, other text"), (5, "ß é 漢字 🙂 x"), (6, "word " * 30_000), *texts]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["c"] * 1, 7, *["c"] * 8, 1, *["c"] * 3) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
