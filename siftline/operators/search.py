"""Ranked phrase search: BM25 over all text fields, with the tokens of Unicode letters and digits."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import or_empty

SEARCH_FIELDS = ["subject", "content", "doccontent", "sender", "from_addr", "recipient"]
K1, B = 1.2, 0.75


def _folding() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks with a diacritic, and the letters without it."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFD", chr(c))[0] != chr(c)]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


_WITH, _WITHOUT = _folding()


def fold(c: Column) -> Column:
    return F.lower(F.translate(c, _WITH, _WITHOUT))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, folded; a run of ideographs is one token."""
    return F.filter(F.split(fold(or_empty(c)), r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")


def phrase_tokens(phrase: str) -> list[str]:
    folded = "".join(unicodedata.normalize("NFD", ch)[0] if ch in _WITH else ch for ch in phrase).lower()
    out, now = [], ""
    for ch in folded:
        if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co":
            now += ch
        elif now:
            out.append(now)
            now = ""
    return out + [now] if now else out


def phrase_hits(field_tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in the tokens of one field; hits may overlap."""
    k = len(phrase)
    n = F.size(field_tokens)
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: reduce(lambda x, y: x & y, (F.get(field_tokens, i + j) == p for j, p in enumerate(phrase)))))


def field_counts(c: Column, phrase: list[str]) -> Column:
    """struct(d, f): the number of tokens of a field and of the phrase in them. The tokens are bound once, as the one element of an
    array, so no rewriting of the plan puts the splitting of the text into the loop over its places."""
    bound = F.transform(F.array(tokens(c)), lambda t: F.struct(F.size(t).alias("d"), phrase_hits(t, phrase).alias("f")))
    return F.element_at(bound, 1)


def search(messages: DataFrame, phrase: str, fields: list[str] | None = None, limit: int | None = 50, offset: int = 0, order: str = "seq") -> DataFrame:
    """Rows with the phrase in one of the fields, best first, with score (higher is better; equal scores in the table's order).

    The keyword is one phrase, whatever it contains; without any token nothing is found. Row counts, mean length and document
    frequency come from one aggregate pass; two numbers and a count are all that the second pass needs.
    """
    fields = fields or [f for f in SEARCH_FIELDS if f in messages.columns]
    want = phrase_tokens(phrase)
    if not want:
        return messages.withColumn("score", F.lit(0.0)).where(F.lit(False))
    each = [field_counts(F.col(f), want) for f in fields]
    counted = messages.withColumn("_c", F.struct(sum((c["d"] for c in each), F.lit(0)).alias("d"), sum((c["f"] for c in each), F.lit(0)).alias("f")))
    counted = counted.select("*", F.col("_c.d").alias("_d"), F.col("_c.f").alias("_f")).drop("_c")
    n_all, mean, n_hit = counted.agg(F.count("*"), F.avg("_d"), F.count_if(F.col("_f") > 0)).first()
    if not n_hit:
        return messages.withColumn("score", F.lit(0.0)).where(F.lit(False))
    import math

    idf = math.log((n_all - n_hit + 0.5) / (n_hit + 0.5))
    idf = idf if idf > 0 else 1e-6
    f = F.col("_f").cast("double")
    score = F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_d") / F.lit(float(mean))))
    out = counted.where("_f > 0").withColumn("score", score).drop("_d", "_f")
    if limit is None:
        return out
    return out.orderBy(F.desc("score"), order).offset(offset).limit(limit)


def inverted_index(messages: DataFrame, fields: list[str] | None = None, key: str = "record_id") -> DataFrame:
    """token, record_id, field, pos: a derived index, to be written by snapshot and appended to for new rows."""
    fields = fields or [f for f in SEARCH_FIELDS if f in messages.columns]
    out = None
    for f in fields:
        part = messages.select(F.col(key), F.lit(f).alias("field"), F.posexplode(tokens(F.col(f))).alias("pos", "token"))
        out = part if out is None else out.unionByName(part)
    return out.select("token", key, "field", "pos")
