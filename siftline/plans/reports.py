"""More registered queries: reports, counters, comparisons on low-confidence rows, samples and lookups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import cluster, evaluate, fusion, labeling, rules, sampling, search, store, taxonomy
from siftline.plans.registry import _G, _K, _L, _MSG, _S, _TOK, _V, SCHEME, TAXONOMY, confusion, docs_as_messages, fused, labelled, long_table, query, rules_sql, table
from siftline.sources import messages as M
from siftline.sources import sinks

_T = ", ".join(f"'{t}'" for t in TAXONOMY)


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, 'https?://\S*|[A-Za-z0-9]\S*\.[A-Za-z]{2,}\S*')) AS url FROM documents")
def extract_urls(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.extract_urls(F.col("text"))).alias("url"))


def events_as_messages(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("record_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), X.json_int(F.col("props"), "k").alias("size"),
        F.col("event_type").alias("region"), F.concat(F.lit(" User"), user).alias("sender"), F.concat(F.lit("10.0.0."), F.col("user_id") % 7).alias("ip"), F.when(F.col("user_id") % 3 == 0, "").otherwise("L1").alias("license_id"),
        F.when(F.col("event_id") % 2 == 0, " ").otherwise("text").alias("content"), F.lit("").alias("attach"), (F.col("event_id") % 4).alias("wlist_cnt"), F.lit(0).cast("long").alias("dwlist_cnt"),
        X.split_recipients(F.concat(F.lit("A"), user, F.lit("; b"))).alias("parsed_rcpts"), X.extract_urls(F.concat(F.lit("http://h"), F.col("user_id") % 5, F.lit(".org/x"))).alias("parsed_urls"),
    )


_E = """e AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, coalesce(try_cast(props->>'k' AS BIGINT), 0) AS size, event_type AS region, ' User' || user_id AS sender, '10.0.0.' || user_id % 7 AS ip,
 CASE WHEN user_id % 3 = 0 THEN '' ELSE 'L1' END AS license_id, event_id % 2 = 1 AS has_content, event_id % 4 AS wlist_cnt, user_id FROM events)"""
_TOP = "SELECT '{s}' AS section, v AS value, cnt::DOUBLE AS cnt FROM (SELECT {v} AS v, count(*) AS cnt, min(seq) AS f FROM e {where} GROUP BY 1 ORDER BY cnt DESC, {tie} LIMIT {n})"


def _top(section: str, value: str, n: int, tie: str = "f", where: str = "") -> str:
    return "(" + _TOP.format(s=section, v=value, n=n, tie=tie, where=where) + ")"


_TOTALS = "SELECT '{s}' AS section, x.k AS value, x.v AS cnt FROM (SELECT unnest([{items}]) AS x FROM (SELECT count(*) AS total, round_even(sum(size) / 1024.0, 1) AS size_kb, round_even(avg(size), 1) AS avg_size, count(*) FILTER (WHERE has_content) AS with_content, round_even(avg(wlist_cnt), 4) AS avg_wlist FROM e))"
_MONTHS = "SELECT '{s}' AS section, substr(timestamp, 1, 7) AS value, count(*)::DOUBLE AS cnt FROM e GROUP BY 2"


def _item(name: str, value: str | None = None) -> str:
    return f"{{'k': '{name}', 'v': {value or name}::DOUBLE}}"


@query(f"WITH {_E} " + _TOTALS.format(s="overview", items=", ".join(_item(x) for x in ("total", "size_kb", "avg_size"))) + " UNION ALL " + _MONTHS.format(s="monthly") + " UNION ALL " + " UNION ALL ".join((_top("top_region", "region", 30, "v"), _top("top_sender", "sender", 30, "v"), _top("top_ip", "ip", 30, "v"), _top("top_license_id", "license_id", 30, "v", "WHERE license_id <> ''"))))
def store_report(spark, sf):
    return store.long_stats(store.report(events_as_messages(spark, sf), ("region", "sender", "ip", "license_id")))


@query(f"WITH {_E} " + _TOTALS.format(s="totals", items=", ".join([*(_item(x) for x in ("total", "size_kb", "avg_size", "with_content", "avg_wlist")), _item("with_attach", "0"), _item("avg_dwlist", "0")])) + " UNION ALL " + _MONTHS.format(s="months") + " UNION ALL " + " UNION ALL ".join((_top("regions", "region", 20), _top("senders", "lower(trim(sender))", 50), _top("licenses", "license_id", 30, "f", "WHERE license_id <> ''"), _top("ips", "ip", 20), _top("domains", "'h' || user_id % 5 || '.org'", 20)))
       + " UNION ALL (SELECT 'recipients' AS section, v AS value, cnt::DOUBLE AS cnt FROM (SELECT v, count(*) AS cnt, min(seq) AS f FROM (SELECT unnest(['a' || user_id, 'b']) AS v, seq FROM e) GROUP BY v ORDER BY cnt DESC, f LIMIT 50))")
def log_statistics(spark, sf):
    return store.long_stats(store.log_stats(events_as_messages(spark, sf)))


@query(f"""WITH {_V}, m AS (SELECT category, confidence FROM f WHERE category <> '')
SELECT 'buckets' AS section, CASE WHEN confidence < 0.3 THEN '0.0-0.3' WHEN confidence < 0.5 THEN '0.3-0.5' WHEN confidence < 0.7 THEN '0.5-0.7' WHEN confidence < 0.9 THEN '0.7-0.9' ELSE '0.9-1.0' END AS k1, NULL::VARCHAR AS k2, count(*)::BIGINT AS n FROM m GROUP BY 2
UNION ALL SELECT 'by_category', category, NULL, count(*) FROM m GROUP BY category UNION ALL SELECT 'sources', source, NULL, count(*) FROM f GROUP BY source
UNION ALL (SELECT 'agreement', rule_cat, model_cat, count(*) AS n FROM f WHERE rule_cat <> '' AND model_cat <> '' GROUP BY 2, 3 ORDER BY n DESC, rule_cat, model_cat LIMIT 30)
UNION ALL (SELECT 'overrides', rule_cat, category, count(*) AS n FROM f WHERE source = 'model' AND rule_cat <> '' AND rule_cat <> category GROUP BY 2, 3 ORDER BY n DESC, rule_cat, category LIMIT 20)
UNION ALL SELECT 'rule_coverage', NULL, NULL, count(*) FILTER (WHERE rule_cat <> '') FROM f
UNION ALL SELECT 'rule_distribution', c, NULL, (SELECT count(*) FROM f WHERE rule_cat = c) FROM (SELECT unnest([{_T}]) AS c)""")
def fusion_report(spark, sf):
    sections = fusion.report(fused(spark, sf), TAXONOMY)
    return fusion.long_report(sections | {"rule_coverage": sections["rule_coverage"].select("classified")})


@query(f"WITH {_V} SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE category <> '')::BIGINT AS classified, count(*) FILTER (WHERE category = '')::BIGINT AS unclassified, count(*) FILTER (WHERE category = '' AND rule_cat <> '')::BIGINT AS by_key FROM f")
def fused_counters(spark, sf):
    return fusion.summary(fused(spark, sf), "rule_cat")


@query(f"WITH {_K} SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE x.category <> '')::BIGINT AS classified, count(*) FILTER (WHERE x.category = '')::BIGINT AS unclassified, count(*) FILTER (WHERE x.category = '' AND k.category IS NOT NULL)::BIGINT AS by_key FROM x LEFT JOIN k USING (ip)")
def pipeline_counters(spark, sf):
    from siftline.operators import propagate

    return fusion.summary(propagate.two_pass(labelled(spark, sf)), "key_category")


# Comparison of labels


_ALIGN = f"""{_V}, q AS (SELECT truth AS a, model_cat AS b, count(*) AS cnt FROM f WHERE model_cat <> '' GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, a, b) AS r FROM q),
g AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub UNION ALL SELECT o.r, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END FROM g JOIN o ON o.r = g.r + 1),
z AS (SELECT ua, ub FROM g ORDER BY r DESC LIMIT 1), w AS (SELECT unnest(ub) AS b, unnest(ua) AS mapped FROM z), y AS (SELECT record_id, truth AS a, model_cat AS b, mapped FROM f JOIN w ON model_cat = b)"""


def _compared(spark, sf) -> dict[str, DataFrame]:
    x = fused(spark, sf)
    return evaluate.compare_labels(x.select("record_id", F.col("truth").alias("label")), x.where("model_cat <> ''").select("record_id", F.col("model_cat").alias("label")))


@query(f"WITH RECURSIVE {_ALIGN} SELECT a, count(*)::BIGINT AS n, count(*) FILTER (WHERE a = mapped)::BIGINT AS agree FROM y GROUP BY a")
def label_agreement_by_class(spark, sf):
    return _compared(spark, sf)["by_label"]


@query(f"WITH RECURSIVE {_ALIGN} SELECT a, mapped, count(*)::BIGINT AS cnt FROM y GROUP BY ALL")
def label_aligned_confusion(spark, sf):
    return _compared(spark, sf)["aligned"]


@query(f"WITH {_V} SELECT truth AS a, model_cat AS b, count(*)::BIGINT AS cnt FROM f WHERE model_cat <> '' GROUP BY ALL")
def label_raw_confusion(spark, sf):
    return _compared(spark, sf)["confusion"]


@query(f"WITH RECURSIVE {_ALIGN} SELECT record_id, a, b, mapped FROM y WHERE a <> mapped")
def label_mismatches(spark, sf):
    return _compared(spark, sf)["mismatches"].select("record_id", "a", "b", "mapped")


# Rows of low confidence


def _low(spark, sf) -> DataFrame:
    """Rows whose model is unsure, against labels that exist for two thirds of them and are valid for most of these; one strategy in five rows is missing."""
    x = fused(spark, sf)
    labels = x.where("seq % 3 <> 0").select("record_id", F.when(F.col("truth") == "", "other").otherwise(F.col("truth")).alias("llm_category"), ((F.col("seq") % 10) / 10.0).cast("double").alias("llm_confidence"), F.when(F.col("seq") % 7 == 0, "timeout").otherwise("").alias("error"))
    return evaluate.compare_on(evaluate.low_confidence(x), labels, x.where("seq % 5 <> 0"), TAXONOMY)


_LOW = f"""{_V}, low AS (SELECT seq, record_id, truth FROM f WHERE model_conf < 0.7 AND seq % 3 <> 0 AND seq % 7 <> 0 AND seq % 10 >= 5 AND truth IN ({_T})),
r AS (SELECT low.record_id, low.truth, coalesce(s.rule_cat, '') AS rule_cat, coalesce(s.model_cat, '') AS model_cat, coalesce(s.category, '') AS category FROM low LEFT JOIN (SELECT * FROM f WHERE seq % 5 <> 0) s ON s.record_id = low.record_id)"""


@query(f"WITH {_LOW} SELECT * FROM r")
def low_confidence_rows(spark, sf):
    return _low(spark, sf)


@query(f"WITH {_LOW} SELECT truth, model_cat AS pred, count(*)::BIGINT AS cnt FROM r GROUP BY ALL")
def low_confidence_confusion(spark, sf):
    return evaluate.confusion(_low(spark, sf), "truth", "model_cat")


@query(f"WITH {_LOW} SELECT rule_cat AS a, model_cat AS b, count(*)::BIGINT AS cnt FROM r WHERE rule_cat <> '' GROUP BY ALL ORDER BY cnt DESC, a, b LIMIT 30")
def low_confidence_pairs(spark, sf):
    return evaluate.pair_counts(_low(spark, sf), limit=30)


@query(f"WITH {_LOW} SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE rule_cat <> '')::BIGINT AS classified, round_even(100.0 * count(*) FILTER (WHERE rule_cat <> '') / count(*), 1) AS pct FROM r")
def low_confidence_rule_coverage(spark, sf):
    return fusion.coverage(_low(spark, sf), "rule_cat")


@query(f"""WITH {_LOW}, n AS (SELECT unnest([{_T}]) AS category), c AS (SELECT n.category, count(*) FILTER (WHERE truth = n.category AND model_cat = n.category) AS tp, count(*) FILTER (WHERE truth = n.category AND model_cat <> n.category) AS fn, count(*) FILTER (WHERE truth <> n.category AND model_cat = n.category) AS fp FROM n, r GROUP BY n.category)
SELECT (SELECT count(*) FROM r)::BIGINT AS n, round((SELECT count(*) FILTER (WHERE truth = model_cat) / count(*) FROM r), 9) AS accuracy, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS macro_f1, round(100 * avg(coalesce(tp / nullif(tp + fp + fn, 0), 0)), 7) AS iou_score FROM c""")
def low_confidence_scores(spark, sf):
    out = evaluate.scores(low_confidence_confusion(spark, sf), TAXONOMY)
    return out.select("n", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"), F.round("iou_score", 7).alias("iou_score"))


@query(f"""WITH {_V}, t AS (SELECT record_id, truth FROM f WHERE truth <> '' AND seq % 10 >= 5)
SELECT strategy, t.record_id, truth, pred FROM t JOIN (SELECT 'rule' AS strategy, record_id, rule_cat AS pred FROM f UNION ALL SELECT 'model', record_id, model_cat FROM f WHERE seq % 5 <> 0 UNION ALL SELECT 'fused', record_id, category FROM f) s USING (record_id)""")
def sample_results(spark, sf):
    labels = fused(spark, sf).select("record_id", F.col("truth").alias("llm_category"), ((F.col("seq") % 10) / 10.0).cast("double").alias("llm_confidence"), F.lit("").alias("error"))
    long = long_table(spark, sf).where("strategy <> 'model' OR seq % 5 <> 0")
    return evaluate.sample_results(labels, labels, long, TAXONOMY)


@query(f"WITH {_V} SELECT record_id FROM f WHERE seq % 4 <> 0 AND truth <> '' AND model_conf >= 0.5")
def valid_labels(spark, sf):
    x = fused(spark, sf).select("record_id", F.col("truth").alias("llm_category"), F.col("model_conf").alias("llm_confidence"), F.when(F.col("seq") % 4 == 0, "failed").alias("error"))
    return x.where(evaluate.valid_label(TAXONOMY)).select("record_id")


@query(f"WITH {_V}, t AS (SELECT record_id, coalesce(nullif(model_cat, ''), nullif(rule_cat, ''), '') AS label, coalesce(nullif(model_conf, 0), nullif(rule_conf, 0), 0) AS confidence FROM f) SELECT record_id, label, round(confidence, 9) AS confidence FROM t WHERE label <> '' AND confidence >= 0.5")
def training_labels(spark, sf):
    x = fused(spark, sf).withColumnsRenamed({"model_cat": "llm_category", "model_conf": "llm_confidence", "rule_cat": "rule_category", "rule_conf": "rule_confidence"})
    cat, conf, good = evaluate.training_label(TAXONOMY)
    return x.where(good).select("record_id", cat.alias("label"), F.round(conf, 9).alias("confidence"))


# Labelling


def _llm(spark, sf) -> DataFrame:
    x = fused(spark, sf).join(docs_as_messages(spark, sf).select("record_id", "subject"), "record_id")
    return x.select("seq", "record_id", "subject", F.col("model_cat").alias("llm_category"), F.col("rule_cat").alias("rule_category"), F.lit("because").alias("llm_reason"), F.when(F.col("seq") % 9 == 0, "timeout").otherwise("").alias("error"))


@query(f"WITH {_V}, g AS (SELECT * FROM f WHERE seq % 9 <> 0 AND model_cat <> '') SELECT 'llm' AS which, model_cat AS category, count(*)::BIGINT AS cnt FROM g GROUP BY 2 UNION ALL SELECT 'rule', rule_cat, count(*)::BIGINT FROM g WHERE rule_cat <> '' GROUP BY 2")
def label_distributions(spark, sf):
    return labeling.label_distribution(_llm(spark, sf))


@query(f"WITH {_V} SELECT record_id, substr(split_part(text, E'\\n', 1), 1, 80) AS subject, rule_cat AS rule, model_cat AS llm, 'because' AS llm_reason FROM f JOIN documents ON doc_id = seq WHERE seq % 9 <> 0 AND model_cat <> '' AND rule_cat <> '' AND model_cat <> rule_cat ORDER BY seq LIMIT 20")
def label_disagreements(spark, sf):
    return labeling.first_disagreements(_llm(spark, sf))


@query("SELECT round(sum(length(text) * 0.000001::DOUBLE + turn * 0.000002::DOUBLE), 9) AS cost FROM conversations")
def labelling_cost(spark, sf):
    rows = table(spark, sf, "conversations").select(F.char_length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return labeling.total_cost(rows, 0.000001, 0.000002).select(F.round("cost", 9).alias("cost"))


@query("SELECT p_type AS label, count(*)::BIGINT AS cnt, list_slice(list(p_partkey::VARCHAR ORDER BY p_partkey), 1, 15)::VARCHAR AS first_ids FROM part GROUP BY p_type")
def open_label_groups(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("llm_category"), F.col("p_partkey").cast("string").alias("record_id"), F.col("p_partkey").alias("seq"))
    out = M.open_label_groups(rows)
    return out.select("label", "cnt", F.concat(F.lit("["), F.array_join("first_ids", ", "), F.lit("]")).alias("first_ids"))


# Lookups, samples, exports


@query(f"WITH {_MSG} SELECT record_id, subject, region FROM m WHERE record_id = '17'")
def lookup_row(spark, sf):
    return store.by_id(docs_as_messages(spark, sf), "17").select("record_id", "subject", "region")


@query("SELECT doc_id::VARCHAR AS record_id, lang FROM documents WHERE doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)")
def fetch_ids(spark, sf):
    ids = table(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").cast("string").alias("record_id"))
    return store.fetch(docs_as_messages(spark, sf), ids).select("record_id", F.col("region").alias("lang"))


@query(f"WITH {_MSG} SELECT record_id FROM m ORDER BY seq LIMIT 25")
def first_rows(spark, sf):
    return store.first_rows(docs_as_messages(spark, sf), 25).select("record_id")


@query(f"""
WITH t AS (SELECT conv_id, turn, {_TOK.format(c="text")} AS w FROM conversations),
h AS (SELECT conv_id, turn, len(w) AS d, len(list_filter(w, lambda x: x = 'the')) AS f FROM t),
s AS (SELECT count(*) AS n, avg(d) AS mean, count(*) FILTER (WHERE f > 0) AS hit FROM h),
i AS (SELECT n, mean, CASE WHEN ln((n - hit + 0.5) / (hit + 0.5)) > 0 THEN ln((n - hit + 0.5) / (hit + 0.5)) ELSE 1e-6 END AS idf FROM s)
SELECT conv_id, turn FROM h, i WHERE f > 0 ORDER BY idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * d / mean)) DESC, conv_id * 1000 + turn LIMIT 20 OFFSET 10""")
def fts_page(spark, sf):
    c = table(spark, sf, "conversations").withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))
    return search.search(c, "The", ["text"], limit=20, offset=10).select("conv_id", "turn")


@query("WITH s AS (SELECT doc_id::VARCHAR AS record_id, lang, md5('42|' || doc_id::VARCHAR) AS h FROM documents) SELECT record_id, lang AS label FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, record_id) AS k FROM s) WHERE k <= 50")
def capped_per_label(spark, sf):
    m = docs_as_messages(spark, sf).select("record_id", F.col("region").alias("label"))
    return sampling.capped_per_label(m, "label", 50)


@query("""WITH s AS (SELECT doc_id::VARCHAR AS record_id, lang, md5('42|' || doc_id::VARCHAR) AS h FROM documents), n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang), t AS (SELECT count(*) AS total, ceil(count(*) * 0.15) AS t, ceil((count(*) - ceil(count(*) * 0.15)) * (0.15 / 0.85) - 1e-9) AS v FROM s),
c AS (SELECT lang, n, sum(n) OVER (ORDER BY lang) AS z, sum(n) OVER (ORDER BY lang) - n AS a FROM n), q AS (SELECT lang, n, round_even(t * z / total, 0) - round_even(t * a / total, 0) AS tq, round_even(v * z / total, 0) - round_even(v * a / total, 0) AS vq FROM c, t)
SELECT 'test' AS split, lang AS label, tq::BIGINT AS cnt FROM q UNION ALL SELECT 'validation', lang, vq::BIGINT FROM q UNION ALL SELECT 'train', lang, (n - tq - vq)::BIGINT FROM q""")
def split_distribution(spark, sf):
    m = docs_as_messages(spark, sf).select("record_id", F.col("region").alias("lang"))
    return sampling.split_distribution(sampling.stratified_split(m, "lang"), "lang")


@query(f"WITH {_V}, x AS (SELECT CASE category WHEN 'abuse' THEN 0 WHEN 'contact' THEN 1 WHEN 'junk' THEN 2 WHEN 'legal' THEN 3 WHEN 'network' THEN 5 ELSE -1 END::INT AS spam_type FROM f) SELECT spam_type, count(*)::BIGINT AS cnt FROM x WHERE spam_type BETWEEN 0 AND 4 GROUP BY spam_type")
def export_histogram(spark, sf):
    return sinks.export_histogram(sinks.numeric_labels(fused(spark, sf), {"abuse": 0, "contact": 1, "junk": 2, "legal": 3, "network": 5}))


@query("SELECT count(*)::BIGINT AS matched FROM documents WHERE doc_id IN (SELECT o_orderkey FROM orders)")
def bulk_update_count(spark, sf):
    return sinks.matched_rows(docs_as_messages(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.lit("x").alias("category")))


@query(f"WITH {_V} SELECT '{{\"counters\":' || json_object('total', count(*), 'classified', count(*) FILTER (WHERE category <> ''), 'unclassified', count(*) FILTER (WHERE category = ''))::VARCHAR || ',\"wins\":' || json_object('model_wins', count(*) FILTER (WHERE model_cat <> '' AND model_cat <> rule_cat), 'rule_wins', count(*) FILTER (WHERE rule_cat <> '' AND model_cat = ''))::VARCHAR || '}}' AS json FROM f")
def report_json(spark, sf):
    x = fused(spark, sf)
    return sinks.report_json({"counters": fusion.summary(x), "wins": evaluate.wins(x)})


@query("SELECT doc_id::VARCHAR AS record_id, '' AS from_name, split_part(text, E'\\n', 1) AS subject, substr(text, 1, 500) AS content FROM documents WHERE doc_id % 11 = 0")
def validation_sample(spark, sf):
    m = docs_as_messages(spark, sf)
    older = m.withColumns({"seq": F.lit(-1).cast("long"), "content": F.lit("old")})
    sample = m.where("seq % 11 = 0").select("record_id").unionByName(m.limit(1).select(F.lit("no such row").alias("record_id")))
    return sinks.sample_rows(sample, m.unionByName(older))


# Rules, taxonomy, clusters


@query(rules_sql(M.default_rules(), "rule_category") + " SELECT rule_category AS category, count(*)::BIGINT AS cnt FROM r GROUP BY 1")
def default_rules(spark, sf):
    held = M.default_rules()
    out = rules.classify(docs_as_messages(spark, sf), held, rules.categories(held))
    return out.groupBy(F.col("rule_category").alias("category")).agg(F.count("*").alias("cnt"))


_P = "p AS (SELECT p_type AS label, count(*)::BIGINT AS cnt, CASE WHEN p_type LIKE '%STEEL%' OR p_type LIKE '%BRASS%' OR p_type LIKE '%COPPER%' THEN 'metal' WHEN p_type LIKE '%POLISHED%' OR p_type LIKE '%BURNISHED%' THEN 'bright' WHEN p_type LIKE '%SMALL%' THEN 'small' END AS class FROM part GROUP BY p_type)"


def _labels(spark, sf) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("cnt"))


@query(f"WITH {_P} SELECT label, cnt, class, rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY cnt DESC, label) AS rank FROM p WHERE class IS NOT NULL) WHERE rank <= 8")
def scheme_examples(spark, sf):
    return taxonomy.preview(_labels(spark, sf), SCHEME)["examples"].withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_P} SELECT label, cnt FROM p WHERE class IS NULL ORDER BY cnt DESC, label LIMIT 15")
def scheme_unmapped(spark, sf):
    return taxonomy.preview(_labels(spark, sf), SCHEME)["unmapped"].select("label", "cnt")


@query(f"WITH {_P}, d AS (SELECT class, sum(cnt) AS cnt FROM p WHERE class IS NOT NULL GROUP BY class) SELECT (max(cnt) - min(cnt))::BIGINT AS range, round(stddev_samp(cnt), 6) AS stdev FROM d")
def scheme_spread(spark, sf):
    return taxonomy.preview(_labels(spark, sf), SCHEME)["spread"].select("range", F.round("stdev", 6).alias("stdev"))


_LISTS = {"warm": ["NATION_3", "NATION_5", "NATION_7"], "cold": ["NATION_11", "NATION_12", "NATION_3"]}


@query("WITH l AS (SELECT n_name AS label, count(*) AS cnt FROM nation GROUP BY 1), t AS (SELECT * FROM (VALUES ('NATION_3', 'warm'), ('NATION_5', 'warm'), ('NATION_7', 'warm'), ('NATION_11', 'cold'), ('NATION_12', 'cold'), ('NATION_3', 'cold')) v(label, class)) SELECT class, sum(cnt)::BIGINT AS cnt, count(*)::BIGINT AS labels FROM l JOIN t USING (label) GROUP BY class UNION ALL SELECT NULL, coalesce(sum(cnt), 0)::BIGINT, count(*)::BIGINT FROM l WHERE label NOT IN (SELECT label FROM t)")
def exact_list_sizes(spark, sf):
    labels = table(spark, sf, "nation").groupBy(F.col("n_name").alias("label")).agg(F.count("*").alias("cnt"))
    sizes, rest = taxonomy.assigned_sizes(labels, _LISTS)
    return sizes.unionByName(rest.agg(F.lit(None).cast("string").alias("class"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"), F.count("*").alias("labels")))


_SIM = f"g AS (SELECT n_name, n_regionkey, {_G} AS g FROM nation), s AS (SELECT x.n_name AS a, y.n_name AS b, x.n_regionkey AS c, y.n_regionkey AS d, len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))) AS sim FROM g x JOIN g y ON x.n_name < y.n_name)"


@query(f"WITH {_SIM} SELECT a, b, round(sim, 9) AS sim FROM s WHERE sim > 0.1 ORDER BY s.sim DESC, a, b LIMIT 20")
def top_pairs(spark, sf):
    out = cluster.top_pairs(table(spark, sf, "nation").select(F.col("n_name").alias("label")), 20, 0.1)
    return out.withColumn("sim", F.round("sim", 9))


@query(f"WITH {_SIM} SELECT c AS cluster, round(avg(sim), 9) AS cohesion FROM s WHERE c = d GROUP BY c")
def cluster_cohesion(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("label"), F.col("n_regionkey").alias("cluster"), F.lit(1).alias("cnt"))
    return cluster.cohesion(n, n).withColumn("cohesion", F.round("cohesion", 9))


@query(f"WITH {_V}, {_L}, e AS (SELECT strategy, category FROM l) SELECT DISTINCT category FROM e WHERE category <> ''")
def union_of_labels(spark, sf):
    x = fused(spark, sf)
    return evaluate.union_labels(x.select(F.col("rule_cat").alias("label")), x.select(F.col("model_cat").alias("label")), x.select(F.col("category").alias("label"))).withColumnRenamed("label", "category")
