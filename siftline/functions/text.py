"""Scalar functions as Column expressions: parsing, normalising and comparing message fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inline flags under which Java's regex engine follows Python's: case, Unicode case, Unicode classes, only \n ends a line.
FLAGS = "(?iuUd)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# What counts as a URL (a scheme and what follows it up to white space, else a run that begins with a letter or
# digit and has a dot before two letters), as an address, and as the host of a URL.
URL = r"https?://\S*|[A-Za-z0-9]\S*\.[A-Za-z]{2,}\S*"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
SCHEME_HOST = r"(?d)^(https?://)?([^/:?#]+).*"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def safe_int(c: Column, default: int = 0) -> Column:
    """The whole number that a text holds, white space around it aside; the default for anything else."""
    return F.coalesce(F.trim(c).try_cast("bigint"), F.lit(default)).cast("bigint")


def json_int(payload: Column, key: str, default: int = 0) -> Column:
    """An integer field of a JSON payload: 12 and " 12 " give 12, 12.7 gives 12, "12.5", text and absent keys give the default."""
    raw = F.get_json_object(payload, f"$['{key}']")
    quoted = F.regexp_like(payload, F.lit(rf'"{key}"\s*:\s*"'))
    number = F.when(quoted, F.trim(raw).try_cast("bigint")).otherwise(raw.try_cast("double").try_cast("bigint"))
    return F.coalesce(number, F.when(raw == "true", F.lit(1)), F.lit(default)).cast("bigint")


def extract_urls(c: Column) -> Column:
    """All URLs from left to right; white space of any script ends one."""
    return F.regexp_extract_all(or_empty(c), F.lit("(?U)" + URL), F.lit(0))


def extract_ips(c: Column) -> Column:
    """Dotted quads; the range of the numbers is not checked."""
    return F.regexp_extract_all(or_empty(c), F.lit(IPV4), F.lit(0))


def split_recipients(c: Column) -> Column:
    return F.filter(F.transform(F.split(or_empty(c), ";"), strip), lambda x: x != "")


def url_domain(c: Column) -> Column:
    return F.regexp_replace(c, SCHEME_HOST, "$2")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def month(c: Column) -> Column:
    return F.substring(c, 1, 7)


def char_bigrams(c: Column) -> Column:
    """The set of a string's characters and of its pairs of neighbours."""
    n = F.char_length(c)
    chars = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(1)))
    pairs = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(2)))
    return F.array_distinct(F.concat(chars, pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda x, y: x | y, (c.contains(w) for w in words), F.lit(False))


def normal_label(c: Column) -> Column:
    """A label that is a whole number in one spelling, any other unchanged."""
    return F.coalesce(c.try_cast("bigint").cast("string"), c)


def parse_label_reply(reply: Column, taxonomy: list[str] | None = None) -> Column:
    """category, confidence and reason of a labeller's JSON reply, bare or between ``` fences.

    With a taxonomy, a category outside it (compared in lower case) becomes empty. A reply that is no JSON object gives nulls.
    """
    text = strip(or_empty(reply))
    inner = F.when(text.startswith("```"), F.regexp_replace(F.split(text, "```")[1], r"^json", "")).otherwise(text)
    inner = strip(inner)
    got = F.from_json(inner, "category string, confidence string, reason string")
    category = strip(or_empty(got["category"]))
    if taxonomy is not None:
        category = F.when(F.lower(category).isin([t.lower() for t in taxonomy]), category).otherwise("")
    confidence = F.coalesce(got["confidence"].try_cast("double"), F.lit(0.0))
    readable = inner.startswith("{") & F.get_json_object(inner, "$").isNotNull()
    return F.when(readable, F.struct(category.alias("category"), confidence.alias("confidence"), or_empty(got["reason"]).alias("reason")))


def model_text(*parts: Column) -> Column:
    """The fields of a message as one text for a model."""
    return F.concat_ws(" [SEP] ", *(or_empty(p) for p in parts))


def prompt(template: str, **fields: Column) -> Column:
    """template with each {name} replaced by that field, cut to its first characters by the caller."""
    out = F.lit(template)
    for k, v in fields.items():
        out = F.replace(out, F.lit("{" + k + "}"), or_empty(v))
    return out
