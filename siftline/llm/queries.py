"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.llm import adaptive_rules, byte_cnn, lattice_lm, lengths, line_runs, mixing, order_minhash, page_text, tiling, warc_store
from siftline.llm.common import read_table


def op1_source_mixing(spark, sf_dir):
    """The mixture of all documents: each source at most twice, every document at least once."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    """The suffix table of the encoded lengths of all whole texts."""
    return lengths.length_report(read_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark, sf_dir):
    """The score of every whole text, from labels outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    scored = byte_cnn.score_quality(docs, byte_cnn.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(byte_cnn.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op4_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return page_text.extract_text(read_table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark, sf_dir):
    """The lattice score of every whole text, and its unigram base."""
    return lattice_lm.score_texts(read_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark, sf_dir):
    """The class of near duplicates of every document."""
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    """Counts of every text, the base rule, and the verdict of its group's thresholds."""
    out = adaptive_rules.apply_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source", "n_lines", "n_caps")


def op8_line_dedup(spark, sf_dir):
    """Every document without its repeated lines, as a digest."""
    out = line_runs.drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op9_warc(spark, sf_dir):
    """Every record of the WARC files that are written of all pages, as read back from them."""
    pages = read_table(spark, sf_dir, "pages")
    return warc_store.read_archive(spark, warc_store.write_archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark, sf_dir):
    """The benchmark coverage of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = tiling.score_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "contaminated", "item_id", "coverage", "n_items")


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_token_counts, op3_quality_classifier, op4_html_extraction, op5_lm_scoring, op6_near_duplicates, op7_quality_rules, op8_line_dedup, op9_warc, op10_decontamination)}

_OP1 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, count(*) AS n_docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
p AS (SELECT *, tokens / (SELECT sum(tokens) FROM s) AS p FROM s),
e AS (SELECT CASE WHEN max(p) = min(p) THEN 0 ELSE round(greatest(0, 1 - ln(2.0) / ln(max(p) / min(p))), 6) END AS alpha FROM p WHERE tokens > 0),
f AS (SELECT p.*, CASE WHEN tokens > 0 THEN round(pow(p, alpha - 1) / (SELECT min(pow(p, alpha - 1)) FROM p, e WHERE tokens > 0), 9) ELSE 1.0 END AS epochs FROM p, e),
q AS (SELECT *, floor(tokens * epochs + 1e-6)::BIGINT AS quota FROM f),
b AS (SELECT greatest(1, ceil(sum(quota) / 1000000.0))::BIGINT AS blocks FROM q),
x AS (SELECT d.doc_id, d.source, d.n_tokens, q.tokens, q.quota,
             unnest(range(0, CASE WHEN tokens > 0 THEN (quota - 1) // tokens + 1 ELSE 1 END)) AS epoch
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, md5(concat_ws('|', 'mix-1', epoch, doc_id)) AS key FROM x),
o AS (SELECT *, (epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM k)
SELECT doc_id, source, n_tokens, epoch::BIGINT AS epoch, CASE WHEN quota > 0 THEN (start::HUGEINT * blocks // quota)::BIGINT ELSE 0 END AS block, start, key
FROM o, b WHERE start < quota OR tokens = 0
"""

_OP7 = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM dup, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
lin AS (SELECT doc_id, list_filter(string_split(text, E'\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x)))::BIGINT AS n_caps
      FROM d JOIN lin ON d.doc_id = lin.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbols, coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeats,
             coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_lines, coalesce(1000 * n_caps // nullif(n_words, 0), 0) AS caps FROM m),
v AS (SELECT lang, source, metric, bin FROM (SELECT * FROM f WHERE NOT base_failed) UNPIVOT (bin FOR metric IN (symbols, repeats, dup_lines, caps))),
g AS (SELECT 'own' AS lev, lang, source, metric, bin FROM v UNION ALL SELECT 'lang', lang, NULL, metric, bin FROM v UNION ALL SELECT 'all', NULL, NULL, metric, bin FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY lev, lang, source, metric ORDER BY bin) AS k, count(*) OVER (PARTITION BY lev, lang, source, metric) AS n FROM g),
q AS (SELECT lev, lang, source, metric, max(n) AS n, min(bin) FILTER (WHERE k * 10 >= n) AS low, min(bin) FILTER (WHERE k * 10 >= 9 * n) AS high FROM r GROUP BY lev, lang, source, metric),
t AS (SELECT lev, lang, source, metric, n, least(1000, high + 10 * (high - low))::BIGINT AS t FROM q),
z AS (SELECT x.lang, x.source, k.metric, (coalesce(a.n, 0) * coalesce(a.t, 0) + 200 * ((coalesce(b.n, 0) * coalesce(b.t, 0) + 200 * coalesce(c.t, 0)) // (coalesce(b.n, 0) + 200))) // (coalesce(a.n, 0) + 200) AS t
      FROM (SELECT DISTINCT lang, source FROM f) x CROSS JOIN (SELECT unnest(['symbols', 'repeats', 'dup_lines', 'caps']) AS metric) k
           LEFT JOIN t a ON a.lev = 'own' AND a.lang IS NOT DISTINCT FROM x.lang AND a.source IS NOT DISTINCT FROM x.source AND a.metric = k.metric
           LEFT JOIN t b ON b.lev = 'lang' AND b.lang IS NOT DISTINCT FROM x.lang AND b.metric = k.metric LEFT JOIN t c ON c.lev = 'all' AND c.metric = k.metric),
w AS (SELECT lang, source, max(t) FILTER (WHERE metric = 'symbols') AS ts, max(t) FILTER (WHERE metric = 'repeats') AS tr, max(t) FILTER (WHERE metric = 'dup_lines') AS td, max(t) FILTER (WHERE metric = 'caps') AS tc FROM z GROUP BY lang, source)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, f.lang, f.source, n_lines, n_caps,
       NOT base_failed AND 1000 * n_symbols <= ts * word_chars + 3000 AND 1000 * n_repeat_words <= tr * n_words + 18000 AND 1000 * n_dup_lines <= td * n_lines + 3000 AND 1000 * n_caps <= tc * n_words + 3000 AS kept
FROM f JOIN w ON w.lang IS NOT DISTINCT FROM f.lang AND w.source IS NOT DISTINCT FROM f.source
"""

_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, doc_id, unnest(string_split(text, E'\n')) AS line, unnest(range(1, len(string_split(text, E'\n')) + 1)) AS pos FROM d)),
k AS (SELECT k, count(DISTINCT r) AS n, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
m AS (SELECT l.r, l.doc_id, l.pos, l.line, k.k IS NOT NULL AND l.doc_id <> k.last AS gone FROM l LEFT JOIN k ON l.k = k.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

_OP9 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
x AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM x
"""

SQL = {"op1_source_mixing": _OP1, "op7_quality_rules": _OP7, "op8_line_dedup": _OP8, "op9_warc": _OP9}
