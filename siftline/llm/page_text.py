"""Main text of web pages: markup first, then a suffix array over each host's token streams for repeated text."""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import join_hot, join_salted, map_arrow, stash
from siftline.llm.order_minhash import kmers

#: Shortest repeated run in tokens; pages of the host that it must be on; share of a block's tokens that runs must cover.
LEAST_RUN, LEAST_PAGES, COVERED = 8, 3, 0.8
#: Inside an article: share of the host's pages, and least number of them, that must have a run.
ARTICLE_SHARE, ARTICLE_PAGES = 0.5, 5
#: Bytes of pages for each bucket of the suffix array; suffixes that a task counts before it emits; runs that are broadcast at most.
BUCKET_BYTES, FLUSH, MOST_RUNS = 16_000_000, 500_000, 2_000_000

# Fixed values of HTML: elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes noscript".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th".split())
NEVER = frozenset("aside button canvas datalist dialog footer form head input label menu nav object optgroup option search select svg template video audio map math".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words of class and id names that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc toolbar topbar masthead "
    "sidebar aside rail widget widgets related recommended recommendations popular trending "
    "footer copyright legal disclaimer cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login register share sharing social follow "
    "comment comments commentlist disqus reply replies respond discussion form search hidden".split()
)
MAIN_MARKS = frozenset("article content post entry story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _marks(attrs: str, tag: str) -> tuple[bool, int]:
    """Whether an element's attributes say that it isn't part of the article, and how strongly that it is (0 to 2)."""
    words, role, off = set(), "", False
    for k, a, b, c in _ATTR.findall(attrs):
        k, v = k.lower(), a or b or c
        if k in ("class", "id"):
            words.update(x.lower() for x in _NAMES.findall(v))
        elif k == "role":
            role = v.strip().lower()
        off = off or k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none", v) is not None
    off = off or role in ROLES or bool(words & MARKS) and tag not in ("html", "body")
    return off, 2 if role == "main" or role == "article" else 1 if words & MAIN_MARKS and tag not in ("html", "body") else 0


def page_blocks(page: str | None) -> list[tuple[str, bool, int]]:
    """blocks() of a page; if names of classes, ids and roles would drop everything, they aren't heeded."""
    found = blocks(page)
    return blocks(page, False) if found and all(off for _, off, _ in found) else found


def blocks(page: str | None, names: bool = True) -> list[tuple[str, bool, int]]:
    """The page's text in blocks, in order: (text, dropped by its markup, how strongly it stands in the article: 0 to 3)."""
    page = page or ""
    out: list[tuple[str, bool, int]] = []
    # Open elements: name, dropped so far, article so far.
    stack: list[tuple[str, bool, int]] = [("", False, 0)]
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, stack[-1][1], stack[-1][2]))

    def close(name: str, stop: frozenset = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCKS:
            flush()
        elif tag in SPACED:
            parts.append(" ")
        if closing:
            if tag in NEVER:
                flush()
            close(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            close("p", BLOCKS - {"p"})
        if tag in ("li", "dt", "dd", "tr"):
            close(tag, frozenset(("ul", "ol", "dl", "table", "menu")))
        off, main = _marks(m[3], tag) if names and m[3].strip() else (False, 0)
        was_off, was_main = stack[-1][1], stack[-1][2]
        if tag in NEVER or tag == "header" and not was_main:
            off = True
        if off and not was_off and tag not in BLOCKS:
            flush()
        stack.append((tag, was_off or off, max(was_main, main, 3 if tag == "article" else 2 if tag == "main" else 0)))
        if m[3].rstrip().endswith("/") and tag == "svg":
            stack.pop()
    parts.append(page[at:])
    flush()
    return out


def token_codes(texts: list[str]) -> list[np.ndarray]:
    return [np.fromiter((zlib.crc32(w.encode()) for w in t.split()), np.int64) for t in texts]


def host_salt(host: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(host.encode(), digest_size=8).digest()))


def _short(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash, as the suffix array keeps them."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(16)).view(np.int64)


@dataclass
class Page:
    """A parsed page: its blocks that the markup does not exclude, where each ends in their token stream, and the selected suffixes
    of that stream: their places and what they begin with (LEAST_RUN tokens, hashed together with the host)."""

    blocks: list[tuple[str, int]]
    ends: np.ndarray
    places: np.ndarray
    runs: np.ndarray


def selected(stream: np.ndarray, ends: np.ndarray, least: int = LEAST_RUN) -> np.ndarray:
    """Places of the suffixes that take part: in each `least` neighbours the one of smallest hash, and those that begin with a block
    or end with one after `least` tokens.

    The choice depends on the tokens near a place alone, so pages with a text in common select the same suffixes in it. Selected
    runs overlap or touch, so a sequence of whole blocks that pages share, of `least` tokens or more, is covered without a gap.
    """
    h = kmers(stream, least)
    if len(stream) < least:
        return np.empty(0, np.int64)
    if len(h) > least:
        near = np.lib.stride_tricks.sliding_window_view(h, least)
        chosen = np.arange(len(near)) + near.argmin(axis=1)
    else:
        chosen = h.argmin()[None]
    starts = np.append(0, ends)[:-1]
    both = np.concatenate([chosen, starts, ends - least])
    return np.unique(both[(both >= 0) & (both < len(h))])


def parse(html: str | None, host: str) -> Page:
    kept = [(t, main) for t, off, main in page_blocks(html) if not off]
    codes = token_codes([t for t, _ in kept])
    stream = np.concatenate([*codes, np.empty(0, np.int64)])
    ends = np.cumsum([len(c) for c in codes], dtype=np.int64)
    places = selected(stream, ends) if len(ends) else np.empty(0, np.int64)
    return Page(kept, ends, places, _short(kmers(stream, LEAST_RUN)[places] ^ host_salt(host)) if len(places) else np.empty(0, np.int64))


def host_mark(host: str) -> int:
    """The entry under which a host's pages are counted."""
    return int(_short(host_salt(host)[None] + np.uint64(1))[0])


def covered_blocks(page: Page, often: np.ndarray) -> list[bool]:
    """Whether COVERED of a block's tokens lie in frequent runs; often: whether each selected run is frequent. Runs that overlap or
    touch are one long substring."""
    n = int(page.ends[-1]) if len(page.ends) else 0
    edge = np.zeros(n + LEAST_RUN + 1, np.int64)
    np.add.at(edge, page.places[often], 1)
    np.add.at(edge, page.places[often] + LEAST_RUN, -1)
    upto = np.append(0, np.cumsum(np.cumsum(edge)[:n] > 0))
    starts = np.append(0, page.ends)[:-1]
    return [e > s and upto[e] - upto[s] >= COVERED * (e - s) for s, e in zip(starts.tolist(), page.ends.tolist(), strict=True)]


def main_text(page: Page, counts: np.ndarray, of_host: int) -> str:
    """The blocks that stay, of those that stand most strongly in the article; counts: on how many pages of the host each selected
    run is, of_host: how many pages it has.

    In an article or main element, text goes that is on ARTICLE_SHARE of the host's pages, and on ARTICLE_PAGES at least: what
    fewer pages share is quoted or copied. If that were more than half of the article, the page is a copy and keeps it. Elsewhere
    text goes that is on LEAST_PAGES pages, unless that were all.
    """
    best = max((m for _, m in page.blocks), default=0)
    marked = best >= 2
    covered = covered_blocks(page, counts >= (max(ARTICLE_PAGES, ARTICLE_SHARE * of_host) if marked else LEAST_PAGES))
    sizes = np.diff(np.append(0, page.ends))
    own = [(t, int(n), c) for (t, m), n, c in zip(page.blocks, sizes, covered, strict=True) if m == best]
    gone = sum(n for _, n, c in own if c)
    if gone > (0.5 if marked else 0.999999) * sum(n for _, n, _ in own):
        return "\n".join(t for t, _, _ in own)
    return "\n".join(t for t, _, c in own if not c)


def packed(runs: np.ndarray) -> bytes:
    return runs.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<i8")[:, 0]


def _summed(runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(runs, kind="stable")
    runs, counts = runs[order], counts[order]
    first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else np.empty(0, np.int64)
    return runs[first], np.add.reduceat(counts, first) if len(runs) else counts


def suffix_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """run, n of the suffix array over the pages of each host, rows (host, html), where n pages or more have the run; n >= LEAST_PAGES.

    The array is dealt by the hash of what a suffix begins with, so equal beginnings stand together whatever the host's size; each
    task sorts and counts its own pages' suffixes first, so a run on all pages of a hot host is one entry of each task.
    """

    def entries(batches):
        held, marks = [], Counter()

        def emit():
            runs, counts = _summed(np.concatenate([*held, np.fromiter(marks, np.int64, len(marks))]), np.concatenate([np.ones(sum(map(len, held)), np.int64), np.fromiter(marks.values(), np.int64, len(marks))]))
            held.clear()
            marks.clear()
            bucket = runs % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist() if buckets <= len(runs) else None
            names = np.arange(buckets) if edges else np.unique(bucket)
            edges = edges or np.append(np.searchsorted(bucket[order], names), len(runs)).tolist()
            parts = [order[a:z] for a, z in zip(edges, edges[1:], strict=False)]
            cols = [pa.array(names.astype(np.int64)), pa.array([packed(runs[x]) for x in parts], pa.binary()), pa.array([zlib.compress(counts[x].astype("<i4").tobytes(), 1) for x in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["bucket", "runs", "counts"])

        for b in batches:
            for host, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(np.unique(parse(x, host).runs))
                marks[host_mark(host)] += 1
            if sum(map(len, held)) >= FLUSH:
                yield emit()
        yield emit()

    def merge(group: pa.Table) -> pa.Table:
        runs = np.concatenate([unpacked(x) for x in group.column("runs").to_pylist()])
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), "<i4") for x in group.column("counts").to_pylist()]).astype(np.int64)
        runs, counts = _summed(runs, counts)
        good = counts >= LEAST_PAGES
        return pa.table([pa.array(runs[good]), pa.array(counts[good])], names=["run", "n"])

    return map_arrow(rows, entries, "bucket long, runs binary, counts binary").groupBy("bucket").applyInArrow(merge, "run long, n long")


_TEXT = ["page_id", "url", "text"]


def _texts(batches, counted):
    """batches of page_id, url, host, html and more; counted(batch, row, runs) gives the counts of runs."""
    for b in batches:
        texts = []
        for k, (host, x) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            page = parse(x, host)
            n = counted(b, k, np.append(page.runs, host_mark(host)))
            texts.append(main_text(page, n[:-1], int(n[-1])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=_TEXT)


def _look_up(runs: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(runs), np.int64)
    at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
    return np.where(known[at] == runs, counts[at], 0)


def _joined(rows: DataFrame, often: DataFrame) -> DataFrame:
    """rows with _found: the frequent runs of each page and their counts; pages of one host and html are looked up once."""

    def own(batches):
        for b in batches:
            for key, host, x in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                runs = np.append(np.unique(parse(x, host).runs), host_mark(host))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key, pa.int64()), len(runs)), pa.array(runs)], names=["_key", "run"])

    keyed = rows.withColumn("_key", F.xxhash64("host", "html"))
    each = stash(map_arrow(keyed.select("_key", "host", "html"), own, "_key long, run long").distinct(), "page-runs")
    found = join_salted(each, often, "run").groupBy("_key").agg(F.collect_list(F.struct("run", "n")).alias("_found"))
    copies = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    return join_hot(keyed, stash(found.join(copies, "_key"), "page-found"), "_key", "_n", least=50).select("page_id", "url", "host", "html", "_found")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html): the main text of the whole page.

    Markup decides first what cannot be part of the article: scripts, styles, menus, headers, footers, sidebars, forms and what
    class, id or role names mark as adverts, notices, comments and the like. Over all other text of a host's pages stands a suffix
    array of token streams; blocks that its repeated substrings cover go, unique ones stay (main_text() has the limits, which are
    numbers of pages and shares of the host, the same at any size). A null or empty html has an empty text; a null url belongs to
    a host of its own; rows that repeat a page_id are pages of their own, no rows give none; other columns are ignored.

    What the second pass looks up, the runs on LEAST_PAGES pages, is broadcast up to MOST_RUNS of them and joined beyond that.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    often = stash(suffix_counts(rows.select("host", "html"), 1 + size // BUCKET_BYTES), "host-runs")
    schema = "page_id long, url string, text string"
    if often.count() <= MOST_RUNS:
        table = often.toArrow()
        order = np.argsort(table["run"].to_numpy())
        held = pages.sparkSession.sparkContext.broadcast((table["run"].to_numpy()[order], table["n"].to_numpy()[order]))
        out = map_arrow(rows, lambda batches: _texts(batches, lambda b, k, runs: _look_up(runs, *held.value)), schema)
    else:

        def counted(b, k, runs):
            found = sorted((r["run"], r["n"]) for r in b.column(4)[k].as_py() or [])
            return _look_up(runs, np.array([r for r, _ in found], np.int64), np.array([n for _, n in found], np.int64))

        out = map_arrow(_joined(rows, often), lambda batches: _texts(batches, counted), schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
