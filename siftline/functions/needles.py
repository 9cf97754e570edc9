"""Fixed texts that any match of a pattern must hold, so that most rows are ruled out without running the pattern."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftline.functions.arrow import bound_batches
from siftline.functions.text import or_empty

#: Most needles of a pattern, and how often a row is expected to hold one more given letter or another given character.
MOST, LETTER, OTHER = 64, 0.5, 0.2
#: How many times longer a pattern takes than the search for one more needle.
PATTERN_COST = 4000
#: Needles that are searched for in one pass over the texts.
GROUP = 500


class _Unread(Exception):
    """A construct that is not read here; its pattern has no needles."""


def needles(pattern: str) -> list[str]:
    """Texts of which any text that the pattern (under FLAGS) matches holds at least one, case aside; none if that can't be told."""
    try:
        exact, need, end = _branches(pattern, 0)
        if end < len(pattern):
            raise _Unread
    except _Unread:
        return []
    return _best([exact, need]) or []


def search(found: list[str]) -> str:
    """An RE2 pattern for any of the needles. Its case folding has the long s and the Kelvin sign, as FLAGS; the dotted capital and
    the dotless small i are added."""
    return "(?i)" + "|".join(re.escape(n).replace("i", "[iİı]") for n in found)


def candidates(spark: SparkSession, text: Column, patterns: dict[int, list[str]]) -> Column:
    """The numbers of those patterns of whose needles a text holds one, in rising order.

    All needles are searched for in one pass (RE2, over Arrow batches), each pattern's own only in texts that hold any."""
    bound_batches(spark)
    groups: list[tuple[str, list[tuple[int, str]]]] = []
    own: list[tuple[int, list[str]]] = []
    for k, found in patterns.items():
        own.append((k, found))
        if sum(len(n) for _, n in own) >= GROUP or k == list(patterns)[-1]:
            groups.append((search(sorted({x for _, n in own for x in n})), [(j, search(n)) for j, n in own]))
            own = []

    def find(texts: pa.Array) -> pa.Array:
        rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for any_of, each in groups:
            at = pc.indices_nonzero(pc.match_substring_regex(texts, any_of))
            some = texts.take(at)
            for k, own in each if len(at) else ():
                hit = at.filter(pc.match_substring_regex(some, own)).to_numpy()
                rows.append(hit)
                keys.append(np.full(len(hit), k, np.int32))
        row, key = np.concatenate(rows).astype(np.int64), np.concatenate(keys)
        ends = np.cumsum(np.bincount(row, minlength=len(texts)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(key[np.argsort(row, kind="stable")]))

    return F.arrow_udf(find, "array<int>")(or_empty(text))


def _cost(found: list[str]) -> float:
    def rare(n: str) -> float:
        p = 1.0
        for ch in n:
            p *= LETTER if ch.isalpha() or ch == " " else OTHER
        return p

    return sum(1 + PATTERN_COST * rare(n) for n in found)


def _best(candidates: list) -> list[str] | None:
    """The cheapest of several sets of needles; each may be None, and one with an empty text says nothing."""
    usable = [sorted(set(c)) for c in candidates if c and "" not in c and len(set(c)) <= MOST]
    return min(usable, key=_cost, default=None)


def _literal(ch: str) -> tuple:
    """ASCII is lowered; ideographs and kana have no case; of any other character no needle is made."""
    known = " " <= ch <= "~" or "ぁ" <= ch <= "鿿"
    return ([ch.lower()], None) if known else (None, None)


def _branches(p: str, i: int) -> tuple:
    """(all texts that the alternatives from i match if these are few, needles, end)."""
    exacts, needs = [], []
    while True:
        exact, need, i = _sequence(p, i)
        exacts.append(exact)
        needs.append(_best([exact, need]))
        if i >= len(p) or p[i] != "|":
            break
        i += 1
    exact = [x for e in exacts for x in e] if all(e is not None for e in exacts) else None
    need = [x for n in needs for x in n] if all(needs) else None
    return (exact if exact is not None and len(exact) <= MOST else None), need, i


def _sequence(p: str, i: int) -> tuple:
    items = []
    while i < len(p) and p[i] not in "|)":
        exact, need, i = _atom(p, i)
        exact, need, i = _repeated(p, i, exact, need)
        items.append((exact, need))
    candidates, whole = [need for _, need in items], None
    for a in range(len(items) + 1):
        run: list | None = [""]
        for exact, _ in items[a:]:
            run = [x + y for x in run for y in exact] if exact is not None and len(run) * len(exact) <= MOST else None
            if run is None:
                break
            candidates.append(run)
        if a == 0:
            whole = run
    return whole, _best(candidates), i


def _repeated(p: str, i: int, exact, need) -> tuple:
    """The item before i under its quantifier, if it has one."""
    if i >= len(p) or p[i] not in "?*+{":
        return exact, need, i
    if p[i] == "{":
        end = p.find("}", i)
        least, _, most = p[i + 1 : end].partition(",")
        if end < 0 or not least.isdecimal() or most and not most.isdecimal():
            raise _Unread
        once, least, i = p[i + 1 : end] in ("1", "1,1"), int(least), end + 1
    else:
        once, least, i = False, int(p[i] == "+"), i + 1
        if p[i - 1] == "?" and exact is not None:
            exact, once = [*exact, ""], True
    if i < len(p) and p[i] in "?+":
        i += 1
    if i < len(p) and p[i] in "?*+{":
        raise _Unread
    if not least:
        return (exact if once else None), None, i
    return (exact if once else None), _best([exact, need]), i


def _atom(p: str, i: int) -> tuple:
    ch = p[i]
    if ch == "(":
        if p.startswith("(?", i) and not p.startswith("(?:", i):
            raise _Unread
        exact, need, i = _branches(p, i + (3 if p.startswith("(?:", i) else 1))
        if i >= len(p):
            raise _Unread
        return exact, need, i + 1
    if ch == "[":
        return _set(p, i + 1)
    if ch == "\\":
        return _escape(p, i + 1)
    if ch in "^$":
        return [""], None, i + 1
    if ch == ".":
        return None, None, i + 1
    if ch in "?*+{}]":
        raise _Unread
    return *_literal(ch), i + 1


def _escape(p: str, i: int) -> tuple:
    ch = p[i : i + 1]
    if not ch or ch.isalnum() and ch not in "dDwWsShHbB":
        raise _Unread
    if ch in "bB":
        if p.startswith("{", i + 1):
            raise _Unread
        return [""], None, i + 1
    return (None, None, i + 1) if ch.isalnum() else (*_literal(ch), i + 1)


def _set(p: str, i: int) -> tuple:
    """A set of up to four plain characters is read; of another only its end."""
    start = i
    if p[i : i + 1] == "]" or p[i : i + 2] == "^]":
        raise _Unread
    while i < len(p) and p[i] != "]":
        if p[i] == "[" or p.startswith("&&", i) or p.startswith(("\\Q", "\\E"), i):
            raise _Unread
        i += 2 if p[i] == "\\" else 1
    if i >= len(p):
        raise _Unread
    body = p[start:i]
    if len(body) > 4 or body[0] == "^" or "\\" in body or "-" in body[1:-1]:
        return None, None, i + 1
    exacts = [_literal(ch)[0] for ch in body]
    return (None if None in exacts else [e[0] for e in exacts]), None, i + 1
