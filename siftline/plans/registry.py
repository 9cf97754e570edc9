"""Registered queries over the test tables, each with the SQL that an independent engine answers it by.

documents stand in for messages (first line: subject; source: sender and address; lang: region), labels for known classes, and
verdicts of rules and of a model are derived from hashes of ids, so that every branch of the policies occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import cluster, evaluate, fusion, labeling, propagate, rules, sampling, search, store, taxonomy
from siftline.sources import messages as M
from siftline.sources import sinks

QUERIES: dict = {}
SQL: dict = {}

TAXONOMY = ["abuse", "contact", "junk", "legal", "network"]
RULES: list[rules.Rule] = [
    ("content", r"licensed? under", "legal", 0.6, "licence line"),
    ("content", r"copyright", "legal", 0.3, "copyright"),
    ("content", r"[a-z0-9.]+@[a-z]+\.", "contact", 0.5, "mail address"),
    ("content", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "network", 0.4, "address"),
    ("content", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "contact", 0.45, "phone number"),
    ("content", r"(idiot|moron|scum|trash|clown)", "abuse", 0.5, "insult"),
    ("content", r"pathetic", "abuse", 0.35, "insult"),
    ("content", r"(###|&&&|%%%)", "junk", 0.7, "symbols"),
    ("content", r"[a-z] \| [a-z]+ \| ", "junk", 0.5, "table of links"),
    ("subject", r"!!", "junk", 0.15, "shouting"),
    ("content", r"AKIA[0-9A-Z]{16}", "network", 0.55, "key"),
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs_as_messages(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("record_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("subject"), F.col("text").alias("content"), F.col("source").alias("sender"), F.col("source").alias("ip"), F.col("lang").alias("region"), F.col("n_chars").alias("size"), F.lit("").alias("from_name"))


_MSG = """m AS (SELECT doc_id AS seq, doc_id::VARCHAR AS record_id, split_part(text, E'\\n', 1) AS subject, text AS content, source AS sender, source AS ip, lang AS region, n_chars AS size FROM documents)"""


def _byte(k: int) -> str:
    return f"('0x' || substr(md5(doc_id::VARCHAR), {2 * k + 1}, 2))::INT"


def verdicts(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    b = [F.conv(F.substring("h", 2 * k + 1, 2), 16, 10).cast("int") for k in range(6)]
    names = F.array(*(F.lit(t) for t in TAXONOMY))
    name = lambda c, n: F.coalesce(F.get(names, c % n), F.lit(""))
    x = d.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("record_id"), name(b[0], 7).alias("rule_cat"), (b[1] % 21 / 20.0).alias("rule_conf"), name(b[2], 6).alias("model_cat"), (b[3] % 101 / 100.0).alias("model_conf"), name(b[4], 5).alias("truth"))
    return x.withColumns({"rule_conf": F.when(F.col("rule_cat") == "", 0.0).otherwise(F.col("rule_conf").cast("double")), "model_conf": F.when(F.col("model_cat") == "", 0.0).otherwise(F.col("model_conf").cast("double"))})


def _name(k: int, n: int) -> str:
    return f"coalesce((['abuse', 'contact', 'junk', 'legal', 'network'])[({_byte(k)} % {n}) + 1], '')"


_V = f"""v0 AS (SELECT doc_id AS seq, doc_id::VARCHAR AS record_id, {_name(0, 7)} AS rule_cat, ({_byte(1)} % 21) / 20.0::DOUBLE AS rule_conf, {_name(2, 6)} AS model_cat, ({_byte(3)} % 101) / 100.0::DOUBLE AS model_conf, {_name(4, 5)} AS truth FROM documents),
v AS (SELECT seq, record_id, rule_cat, CASE WHEN rule_cat = '' THEN 0.0 ELSE rule_conf END::DOUBLE AS rule_conf, model_cat, CASE WHEN model_cat = '' THEN 0.0 ELSE model_conf END::DOUBLE AS model_conf, truth FROM v0),
f AS (SELECT *, CASE WHEN model_cat <> '' AND model_conf >= 0.8 THEN model_cat WHEN model_cat <> '' AND model_cat = rule_cat THEN model_cat WHEN model_cat <> '' AND model_conf >= 0.5 THEN model_cat WHEN rule_cat <> '' AND rule_conf >= 0.7 THEN rule_cat WHEN model_cat <> '' THEN model_cat WHEN rule_cat <> '' THEN rule_cat ELSE '' END AS category,
 CASE WHEN model_cat <> '' AND model_conf >= 0.8 THEN model_conf WHEN model_cat <> '' AND model_cat = rule_cat THEN greatest(model_conf, rule_conf) WHEN model_cat <> '' AND model_conf >= 0.5 THEN model_conf - 0.1::DOUBLE WHEN rule_cat <> '' AND rule_conf >= 0.7 THEN rule_conf WHEN model_cat <> '' THEN model_conf WHEN rule_cat <> '' THEN rule_conf ELSE 0.0 END::DOUBLE AS confidence,
 CASE WHEN model_cat <> '' AND model_conf >= 0.8 THEN 'model' WHEN model_cat <> '' AND model_cat = rule_cat THEN 'consensus' WHEN model_cat <> '' AND model_conf >= 0.5 THEN 'model' WHEN rule_cat <> '' AND rule_conf >= 0.7 THEN 'rule_fallback' WHEN model_cat <> '' THEN 'model' WHEN rule_cat <> '' THEN 'rule_fallback' ELSE '' END AS source FROM v)"""


def fused(spark, sf: str) -> DataFrame:
    return fusion.fuse_rows(verdicts(spark, sf))


def long_table(spark, sf: str) -> DataFrame:
    x = fused(spark, sf)
    parts = [x.select(F.lit(n).alias("strategy"), "seq", "record_id", F.col(c).alias("category"), F.col(k).alias("confidence")) for n, c, k in (("rule", "rule_cat", "rule_conf"), ("model", "model_cat", "model_conf"), ("fused", "category", "confidence"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_L = "l AS (SELECT 'rule' AS strategy, rule_cat AS category, rule_conf AS confidence FROM f UNION ALL SELECT 'model', model_cat, model_conf FROM f UNION ALL SELECT 'fused', category, confidence FROM f)"

# Sources, scalars


@query("SELECT event_id, coalesce(try_cast(props->>'k' AS BIGINT), 0) AS k FROM events")
def parse_json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", X.json_int(F.col("props"), "k").alias("k"))


@query("SELECT c_custkey, coalesce(try_cast(trim(split_part(c_name, '#', 2)) AS BIGINT), 0) AS n, coalesce(try_cast(c_name AS BIGINT), 0) AS none FROM customer")
def safe_int(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.safe_int(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("n"), X.safe_int(F.col("c_name")).alias("none"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}')) AS ip FROM documents")
def extract_ips(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.extract_ips(F.col("text"))).alias("ip"))


@query(r"SELECT regexp_replace(url, '^(https?://)?([^/:?#]+).*', '\2') AS value, count(*)::BIGINT AS cnt FROM pages GROUP BY 1 ORDER BY cnt DESC, value LIMIT 20")
def url_domain_top(spark, sf):
    return store.top_values(table(spark, sf, "pages").select(X.url_domain(F.col("url")).alias("domain")), "domain", 20, check=False)


@query("SELECT p_partkey, unnest(list_filter(list_transform(string_split(replace(p_name, ' ', ';'), ';'), lambda x: trim(x)), lambda x: x <> '')) AS word FROM part")
def split_explode(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(X.split_recipients(F.replace("p_name", F.lit(" "), F.lit(";")))).alias("word"))


@query("SELECT text AS content, min(doc_id) AS seq FROM documents GROUP BY text")
def dedupe_keep_first(spark, sf):
    d = table(spark, sf, "documents").select(F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    return M.keep_first(d, "content")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def ingest_new_only(spark, sf):
    new = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("seq"))
    stored = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.keep_first(new, "o_orderkey", stored=stored).select("o_orderkey")


@query(r"""SELECT event_id::VARCHAR AS record_id, user_id::VARCHAR AS sender, event_type AS region, coalesce(try_cast(props->>'k' AS BIGINT), 0) AS size, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp" FROM events""")
def parse_log_lines(spark, sf):
    e = table(spark, sf, "events")
    payload = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("@timestamp"), F.col("user_id").cast("string").alias("sender"), F.col("event_type").alias("region"), F.get_json_object("props", "$.k").alias("size")))
    good, _ = M.parse_lines(e.select(F.concat_ws("\t", F.col("event_id").cast("string"), payload).alias("value")))
    return good.select("record_id", "sender", "region", "size", "timestamp")


@query("SELECT 'no tab' AS reason, count(*)::BIGINT AS cnt FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'no JSON object', count(*)::BIGINT FROM nation WHERE n_nationkey % 3 = 1")
def parse_rejects(spark, sf):
    n = table(spark, sf, "nation")
    line = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat_ws("\t", "n_name", F.lit("[1]"))).otherwise(F.concat_ws("\t", "n_name", F.lit("{}")))
    return M.parse_lines(n.select(line.alias("value")))[1].groupBy("reason").agg(F.count("*").alias("cnt"))


# Store


@query(f"WITH {_MSG} SELECT record_id FROM m WHERE contains(lower(subject), 'licensed') OR contains(lower(content), 'licensed')")
def keyword_filter(spark, sf):
    return store.keyword_filter(docs_as_messages(spark, sf), "Licensed", ["subject", "content"]).select("record_id")


@query(f"WITH {_MSG} SELECT record_id FROM m WHERE lower(content) LIKE '%apache%2._%' OR lower(subject) LIKE '%apache%2._%' ORDER BY seq LIMIT 50")
def like_search(spark, sf):
    return store.search_like(docs_as_messages(spark, sf), "Apache%2._", ["subject", "content"]).select("record_id")


@query("SELECT record_id FROM (SELECT doc_id::VARCHAR AS record_id, doc_id FROM documents WHERE lang LIKE '%f%') ORDER BY doc_id LIMIT 100")
def search_by_field(spark, sf):
    return store.search_by_field(docs_as_messages(spark, sf), "region", "F").select("record_id")


@query("SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') BETWEEN '2024-01-05' AND '2024-01-12'")
def date_range(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    return store.date_range(e, "2024-01-05", "2024-01-12").select("event_id")


@query("SELECT o_orderpriority AS value, count(*)::BIGINT AS cnt FROM orders GROUP BY 1 ORDER BY cnt DESC, value LIMIT 30")
def top_values(spark, sf):
    return store.top_values(table(spark, sf, "orders"), "o_orderpriority", check=False)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS cnt FROM orders GROUP BY 1")
def monthly_distribution(spark, sf):
    return store.monthly(table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp")))


@query("SELECT count(*)::BIGINT AS total, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS first_ts, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last_ts, round_even(sum(coalesce(try_cast(props->>'k' AS BIGINT), 0)) / 1024.0, 1) AS size_kb, round_even(avg(coalesce(try_cast(props->>'k' AS BIGINT), 0)), 1) AS avg_size FROM events")
def global_report(spark, sf):
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), X.json_int(F.col("props"), "k").alias("size"))
    return store.overview(e)


@query("SELECT CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END AS category, count(*)::BIGINT AS cnt FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def category_distribution(spark, sf):
    return store.category_distribution(labelled(spark, sf))


@query("SELECT CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' ELSE 'unclassified' END AS category, count(*)::BIGINT AS cnt FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def category_summary(spark, sf):
    return store.category_summary(labelled(spark, sf))


def labelled(spark, sf) -> DataFrame:
    known = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("record_id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("category"))
    return docs_as_messages(spark, sf).drop("category").join(known, "record_id", "left")


@query("SELECT doc_id::VARCHAR AS record_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unclassified(spark, sf):
    return store.unclassified(labelled(spark, sf), None).select("record_id")


@query("SELECT doc_id::VARCHAR AS record_id FROM labels JOIN documents USING (doc_id) WHERE quality = 0 ORDER BY doc_id LIMIT 100")
def by_category(spark, sf):
    return store.by_category(labelled(spark, sf), "bad").select("record_id")


@query("SELECT doc_id::VARCHAR AS record_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END AS category FROM documents LEFT JOIN labels USING (doc_id)")
def label_upsert(spark, sf):
    new = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("record_id"), F.lit("toxic").alias("category"))
    return sinks.label_updates(labelled(spark, sf).select("record_id", "category"), new)


@query("WITH w AS (SELECT n_regionkey, n_name, n_nationkey FROM nation) SELECT r_name AS value, count(*)::BIGINT AS cnt FROM w JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY cnt DESC, min(n_nationkey) LIMIT 20")
def ranked_first_seen(spark, sf):
    x = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return store.ranked(x.select(F.col("r_name").alias("value"), F.col("n_nationkey").alias("seq")), 20)


_TOK = r"list_filter(regexp_split_to_array(lower(strip_accents({c})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query(f"""
WITH t AS (SELECT turn, conv_id, {_TOK.format(c="text")} AS w FROM conversations),
h AS (SELECT conv_id, turn, len(w) AS d, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS f FROM t),
s AS (SELECT count(*) AS n, avg(d) AS mean, count(*) FILTER (WHERE f > 0) AS hit FROM h),
i AS (SELECT n, mean, CASE WHEN ln((n - hit + 0.5) / (hit + 0.5)) > 0 THEN ln((n - hit + 0.5) / (hit + 0.5)) ELSE 1e-6 END AS idf FROM s)
SELECT conv_id, turn, round(idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * d / mean)), 9) AS score FROM h, i WHERE f > 0""")
def fts_phrase_bm25(spark, sf):
    out = search.search(table(spark, sf, "conversations"), "of, THE", ["text"], limit=None)
    return out.select("conv_id", "turn", F.round("score", 9).alias("score"))


@query(f"SELECT token, count(*)::BIGINT AS postings, count(DISTINCT conv_id)::BIGINT AS rows FROM (SELECT conv_id, unnest({_TOK.format(c='text')}) AS token FROM conversations) GROUP BY token")
def inverted_index(spark, sf):
    return search.inverted_index(table(spark, sf, "conversations"), ["text"], "conv_id").groupBy("token").agg(F.count("*").alias("postings"), F.countDistinct("conv_id").alias("rows"))


# Rules and propagation


def classified(spark, sf) -> DataFrame:
    return rules.classify(docs_as_messages(spark, sf), RULES, TAXONOMY)


def rules_sql(held: list[rules.Rule], name: str = "rule_category", order: list[str] = ()) -> str:
    """WITH ... r: the verdict of rules over the messages."""
    q = lambda p: p.replace("'", "''")
    names = rules.categories(held, order)
    sums = ", ".join("least(" + " + ".join(f"CASE WHEN regexp_matches({f}, '{q(p)}', 'i') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for f, p, c, w, _ in held if c == n) + f", 1.0::DOUBLE) AS s_{n}" for n in names)
    best = "greatest(" + ", ".join(f"s_{n}" for n in names) + ")"
    cat = "CASE WHEN top < 0.2 THEN '' " + " ".join(f"WHEN s_{n} = top THEN '{n}'" for n in names) + " END"
    return f"WITH {_MSG}, r0 AS (SELECT seq, record_id, ip, {sums} FROM m), r1 AS (SELECT *, {best} AS top FROM r0), r AS (SELECT seq, record_id, ip, {cat} AS {name}, round_even(top, 3) AS rule_confidence FROM r1)"


_R = rules_sql(RULES, order=TAXONOMY).removeprefix("WITH ")


@query(f"WITH {_R} SELECT record_id, rule_category, rule_confidence FROM r")
def rule_scores(spark, sf):
    return classified(spark, sf).select("record_id", "rule_category", "rule_confidence")


@query(f"WITH {_R} SELECT rule_category AS category, count(*)::BIGINT AS cnt FROM r GROUP BY 1")
def rule_category_distribution(spark, sf):
    return classified(spark, sf).groupBy(F.col("rule_category").alias("category")).agg(F.count("*").alias("cnt"))


@query(f"WITH {_MSG} " + " UNION ALL ".join(f"SELECT '{c}' AS category, '{why}' AS reason, count(*)::BIGINT AS cnt FROM m WHERE regexp_matches({f}, '{p}', 'i') HAVING count(*) > 0" for f, p, c, _, why in RULES if why != "insult") + " UNION ALL SELECT 'abuse', 'insult', sum(n)::BIGINT FROM (SELECT regexp_matches(content, '(idiot|moron|scum|trash|clown)', 'i')::INT + regexp_matches(content, 'pathetic', 'i')::INT AS n FROM m) HAVING sum(n) > 0")
def rule_matches(spark, sf):
    return classified(spark, sf).select(F.explode("rule_matches").alias("m")).groupBy("m.category", "m.reason").agg(F.count("*").alias("cnt"))


@query("SELECT * FROM (VALUES ('abuse', 2::BIGINT), ('contact', 2), ('junk', 3), ('legal', 2), ('network', 2)) t(category, rules)")
def rule_counts(spark, sf):
    return rules.rule_counts(spark, RULES, TAXONOMY)


_K = """x AS (SELECT doc_id AS seq, source AS ip, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' ELSE '' END AS category, doc_id::VARCHAR AS record_id FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT ip, category, count(*) AS c, min(seq) AS first FROM x WHERE category <> '' AND trim(ip) <> '' GROUP BY ALL),
k AS (SELECT ip, arg_max(category, (c, -first)) AS category, max(c) / sum(c) AS purity, sum(c)::BIGINT AS n FROM p GROUP BY ip HAVING sum(c) >= 3 AND max(c) / sum(c) >= 0.6)"""


@query(f"WITH {_K} SELECT ip, category, round(purity, 9) AS purity, n FROM k")
def ip_map(spark, sf):
    return propagate.fit_keys(labelled(spark, sf)).withColumn("purity", F.round("purity", 9))


@query(f"WITH {_K} SELECT record_id, k.category, round_even(0.5 * purity * least(1.0, n / 10.0), 3) AS confidence FROM x JOIN k USING (ip) WHERE x.category = ''")
def ip_propagation(spark, sf):
    m = labelled(spark, sf)
    return propagate.propagate(m, propagate.fit_keys(m)).select("record_id", "category", "confidence")


@query(f"WITH {_K} SELECT category, count(*)::BIGINT AS keys FROM k GROUP BY category")
def ip_stats(spark, sf):
    return propagate.key_stats(propagate.fit_keys(labelled(spark, sf)))


@query(f"WITH {_K} SELECT coalesce(nullif(x.category, ''), k.category, '') AS final_category, count(*)::BIGINT AS cnt FROM x LEFT JOIN k USING (ip) GROUP BY 1")
def two_pass_pipeline(spark, sf):
    return propagate.two_pass(labelled(spark, sf)).groupBy("final_category").agg(F.count("*").alias("cnt"))


@query("WITH p AS (SELECT user_id, event_type AS category, count(*) AS c, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, arg_max(category, (c, -first)) AS category, round(max(c) / sum(c), 9) AS purity, sum(c)::BIGINT AS n FROM p GROUP BY user_id HAVING sum(c) >= 3 AND max(c) / sum(c) >= 0.25")
def user_majority(spark, sf):
    e = table(spark, sf, "events").withColumnsRenamed({"event_type": "category", "event_id": "seq"}).withColumn("uid", F.col("user_id").cast("string"))
    return propagate.fit_keys(e, "uid", 3, 0.25).select(F.col("uid").cast("bigint").alias("user_id"), "category", F.round("purity", 9).alias("purity"), "n")


# Fusion


@query(f"WITH {_V} SELECT record_id, category, round(confidence, 9) AS confidence, source FROM f")
def fusion_decision(spark, sf):
    return fused(spark, sf).select("record_id", "category", F.round("confidence", 9).alias("confidence"), "source")


@query(f"WITH {_V} SELECT source, count(*)::BIGINT AS cnt FROM f GROUP BY source")
def fusion_sources(spark, sf):
    return fusion.source_counts(fused(spark, sf))


@query(f"WITH {_V} SELECT CASE WHEN confidence < 0.3 THEN '0.0-0.3' WHEN confidence < 0.5 THEN '0.3-0.5' WHEN confidence < 0.7 THEN '0.5-0.7' WHEN confidence < 0.9 THEN '0.7-0.9' ELSE '0.9-1.0' END AS bucket, count(*)::BIGINT AS cnt FROM f WHERE category <> '' GROUP BY 1")
def confidence_buckets(spark, sf):
    return fusion.confidence_buckets(fused(spark, sf))


@query(f"WITH {_V} SELECT category, count(*)::BIGINT AS n, round_even(avg(confidence), 3) AS mean, round_even(min(confidence), 3) AS low, round_even(max(confidence), 3) AS high, round_even((list_sort(list(confidence)))[(count(*) // 2 + 1)::BIGINT], 3) AS median FROM f WHERE category <> '' GROUP BY category")
def confidence_by_category(spark, sf):
    return fusion.confidence_by_category(fused(spark, sf))


@query(f"WITH {_V} SELECT rule_cat, model_cat, count(*)::BIGINT AS cnt FROM f WHERE rule_cat <> '' AND model_cat <> '' GROUP BY ALL ORDER BY cnt DESC, rule_cat, model_cat LIMIT 30")
def agreement_pairs(spark, sf):
    return fusion.agreement_pairs(fused(spark, sf))


@query(f"WITH {_V} SELECT rule_cat, category, count(*)::BIGINT AS cnt FROM f WHERE source = 'model' AND rule_cat <> '' AND rule_cat <> category GROUP BY ALL ORDER BY cnt DESC, rule_cat, category LIMIT 20")
def override_pairs(spark, sf):
    return fusion.override_pairs(fused(spark, sf))


@query(f"WITH {_V} SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE rule_cat <> '')::BIGINT AS classified, round_even(100.0 * count(*) FILTER (WHERE rule_cat <> '') / count(*), 1) AS pct FROM f")
def rule_coverage(spark, sf):
    return fusion.coverage(fused(spark, sf), "rule_cat")


@query(f"""WITH {_V}, h AS (SELECT truth, model_cat AS model_only, CASE WHEN rule_cat <> '' THEN rule_cat ELSE model_cat END AS rule_else_model,
 CASE WHEN model_conf < 0.7 AND rule_cat <> '' AND rule_conf >= 0.3 THEN rule_cat ELSE model_cat END AS rule_if_03, CASE WHEN model_conf < 0.7 AND rule_cat <> '' AND rule_conf >= 0.5 THEN rule_cat ELSE model_cat END AS rule_if_05,
 CASE WHEN model_conf < 0.7 AND rule_cat <> '' AND rule_conf >= 0.7 THEN rule_cat ELSE model_cat END AS rule_if_07, CASE WHEN model_conf < 0.7 AND model_cat IN ('abuse', 'junk') AND rule_cat <> '' THEN rule_cat ELSE model_cat END AS rule_for FROM f)
SELECT policy, count(*)::BIGINT AS n, count(*) FILTER (WHERE pred = truth)::BIGINT AS correct, round(count(*) FILTER (WHERE pred = truth) / count(*), 9) AS accuracy
FROM (UNPIVOT h ON model_only, rule_else_model, rule_if_03, rule_if_05, rule_if_07, rule_for INTO NAME policy VALUE pred) GROUP BY policy""")
def hybrid_policies(spark, sf):
    out = fusion.hybrid_scores(fused(spark, sf), fusion.policies() | {"rule_for": fusion.rule_for(["abuse", "junk"])})
    return out.withColumn("accuracy", F.round("accuracy", 9))


# Evaluation


@query(f"WITH {_V}, {_L} SELECT strategy, count(*)::BIGINT AS total, count(*) FILTER (WHERE category <> '')::BIGINT AS classified, round_even(100.0 * count(*) FILTER (WHERE category <> '') / count(*), 1) AS pct FROM l GROUP BY strategy")
def strategy_coverage(spark, sf):
    return evaluate.strategy_coverage(long_table(spark, sf))


@query(f"WITH {_V}, {_L} SELECT strategy, category, count(*)::BIGINT AS cnt FROM l GROUP BY ALL")
def strategy_distribution(spark, sf):
    return evaluate.strategy_distribution(long_table(spark, sf))


@query(f"WITH {_V} SELECT 'rule_cat' AS a, 'model_cat' AS b, count(*)::BIGINT AS total, count(*) FILTER (WHERE rule_cat = model_cat)::BIGINT AS agree FROM f UNION ALL SELECT 'rule_cat', 'category', count(*), count(*) FILTER (WHERE rule_cat = category) FROM f UNION ALL SELECT 'model_cat', 'category', count(*), count(*) FILTER (WHERE model_cat = category) FROM f")
def pairwise_agreement(spark, sf):
    return evaluate.pairwise_agreement(fused(spark, sf), ["rule_cat", "model_cat", "category"])


@query(f"WITH {_V}, {_L} SELECT strategy, round_even(avg(confidence), 4) AS mean_conf, count(*) FILTER (WHERE confidence >= 0.9)::BIGINT AS high, count(*) FILTER (WHERE confidence >= 0.7 AND confidence < 0.9)::BIGINT AS medium, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.7)::BIGINT AS low, count(*) FILTER (WHERE confidence < 0.5)::BIGINT AS very_low FROM l WHERE category <> '' GROUP BY strategy")
def confidence_bands(spark, sf):
    return evaluate.confidence_bands(long_table(spark, sf))


@query(f"WITH {_V} SELECT count(*) FILTER (WHERE model_cat <> '' AND model_cat <> rule_cat)::BIGINT AS model_wins, count(*) FILTER (WHERE rule_cat <> '' AND model_cat = '')::BIGINT AS rule_wins FROM f")
def strategy_wins(spark, sf):
    return evaluate.wins(fused(spark, sf))


@query(f"WITH {_V} SELECT truth, category AS pred, count(*)::BIGINT AS cnt FROM f GROUP BY ALL")
def confusion(spark, sf):
    return evaluate.confusion(fused(spark, sf), "truth", "category")


_C = f"""{_V}, n AS (SELECT unnest(['abuse', 'contact', 'junk', 'legal', 'network']) AS category),
c AS (SELECT n.category, count(*) FILTER (WHERE truth = n.category AND f.category = n.category)::BIGINT AS tp, count(*) FILTER (WHERE truth = n.category AND f.category <> n.category)::BIGINT AS fn, count(*) FILTER (WHERE truth <> n.category AND f.category = n.category)::BIGINT AS fp FROM n, f GROUP BY n.category)"""


@query(f"WITH {_C} SELECT category, tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(tp / (tp + fp + fn), 9) AS iou FROM c")
def prf1(spark, sf):
    out = evaluate.per_class(confusion(spark, sf), TAXONOMY)
    return out.select("category", "tp", "fp", "fn", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1", "iou")))


@query(f"WITH {_C} SELECT (SELECT count(*) FROM f)::BIGINT AS n, round((SELECT count(*) FILTER (WHERE truth = category) / count(*) FROM f), 9) AS accuracy, round(avg(2 * tp / (2 * tp + fp + fn)), 9) AS macro_f1, round(sum(2 * tp / (2 * tp + fp + fn) * (tp + fn)) / sum(tp + fn), 9) AS weighted_f1, round(100 * avg(tp / (tp + fp + fn)), 7) AS iou_score FROM c")
def iou_score(spark, sf):
    out = evaluate.scores(confusion(spark, sf), TAXONOMY)
    return out.select("n", *(F.round(x, 9).alias(x) for x in ("accuracy", "macro_f1", "weighted_f1")), F.round("iou_score", 7).alias("iou_score"))


@query(f"WITH {_V} SELECT CASE WHEN rule_cat = truth AND model_cat <> truth THEN 'rule_better' WHEN model_cat = truth AND rule_cat <> truth THEN 'model_better' WHEN rule_cat <> truth AND model_cat <> truth THEN 'both_wrong' ELSE 'both_right' END AS outcome, count(*)::BIGINT AS cnt FROM f WHERE confidence < 0.7 GROUP BY 1")
def outcome_partition(spark, sf):
    low = fused(spark, sf).where("confidence < 0.7")
    return low.groupBy(evaluate.outcome(F.col("truth"), F.col("rule_cat"), F.col("model_cat")).alias("outcome")).agg(F.count("*").alias("cnt"))


@query(f"WITH {_V} SELECT record_id, truth, category AS pred FROM f WHERE truth <> category ORDER BY seq LIMIT 50")
def disagreements(spark, sf):
    return evaluate.disagreements(fused(spark, sf).select("seq", "record_id", "truth", F.col("category").alias("pred"))).select("record_id", "truth", "pred")


@query(f"""WITH RECURSIVE {_V}, q AS (SELECT truth AS a, model_cat AS b, count(*) AS cnt FROM f WHERE model_cat <> '' GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, a, b) AS r FROM q),
g AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub UNION ALL SELECT o.r, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END FROM g JOIN o ON o.r = g.r + 1),
z AS (SELECT ua, ub FROM g ORDER BY r DESC LIMIT 1) SELECT unnest(ub) AS b, unnest(ua) AS mapped FROM z""")
def label_alignment(spark, sf):
    x = fused(spark, sf)
    out = evaluate.compare_labels(x.select("record_id", F.col("truth").alias("label")), x.where("model_cat <> ''").select("record_id", F.col("model_cat").alias("label")))
    return out["mapping"]


@query(f"WITH {_V} SELECT count(*) FILTER (WHERE rule_cat <> '' AND model_cat <> '')::BIGINT AS common, count(*) FILTER (WHERE rule_cat <> '' AND model_cat = '')::BIGINT AS only_a, count(*) FILTER (WHERE rule_cat = '' AND model_cat <> '')::BIGINT AS only_b FROM f")
def label_overlap(spark, sf):
    x = fused(spark, sf)
    return evaluate.compare_labels(x.where("rule_cat <> ''").select("record_id", F.col("rule_cat").alias("label")), x.where("model_cat <> ''").select("record_id", F.col("model_cat").alias("label")))["overlap"]


# Samples


_S = "s AS (SELECT doc_id, source, md5('{seed}|' || doc_id::VARCHAR) AS h FROM documents)"


@query(f"WITH {_S.format(seed='a')}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id::VARCHAR) AS k FROM s) SELECT doc_id::VARCHAR AS record_id, source AS category FROM r WHERE (source = 'src1' AND k <= 5) OR (source = 'src2' AND k <= 12)")
def stratified_quota_sample(spark, sf):
    m = docs_as_messages(spark, sf).select("record_id", F.col("sender").alias("category"))
    return sampling.quota_sample(m, {"src1": 5, "src2": 12}, "a")


_FREE = "list_transform(range(1, len(q) + 1), lambda m: k[m] - q[m])"
_OVER = "list_transform(range(1, len(q) + 1), lambda m: CASE WHEN q[m] > least(10, k[m]) THEN q[m] ELSE -1 END)"


@query(f"""WITH RECURSIVE {_S.format(seed='b')}, c AS (SELECT s.*, lang FROM s JOIN documents USING (doc_id)), n AS (SELECT lang, count(*) AS k FROM c GROUP BY lang),
a AS (SELECT list(lang ORDER BY lang) AS l, list(k::BIGINT ORDER BY lang) AS k, list(least(k, greatest(least(10, k), round_even(100 * k / (SELECT sum(k) FROM n), 0)))::BIGINT ORDER BY lang) AS q FROM n),
g AS (SELECT l, k, q, 0 AS i FROM a UNION ALL SELECT l, k, CASE WHEN list_sum(q) < 100 THEN list_transform(range(1, len(q) + 1), lambda j: q[j] + (j = list_position({_FREE}, list_max({_FREE})))::BIGINT) ELSE list_transform(range(1, len(q) + 1), lambda j: q[j] - (j = list_position({_OVER}, list_max({_OVER})))::BIGINT) END, i + 1 FROM g WHERE list_sum(q) <> least(100, list_sum(k)) AND i < 100),
z AS (SELECT unnest(l) AS lang, unnest(q) AS q FROM (SELECT * FROM g ORDER BY i DESC LIMIT 1)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id::VARCHAR) AS p FROM c)
SELECT doc_id::VARCHAR AS record_id, r.lang AS category FROM r JOIN z ON r.lang = z.lang WHERE p <= q""")
def proportional_sample(spark, sf):
    m = docs_as_messages(spark, sf).select("record_id", F.col("region").alias("category"))
    return sampling.proportional_sample(m, 100, "b")


@query("SELECT doc_id::VARCHAR AS record_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def holdout_anti(spark, sf):
    return sinks.holdout(docs_as_messages(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("record_id"))).select("record_id")


@query(f"WITH {_S.format(seed='c')} SELECT doc_id::VARCHAR AS record_id FROM s ORDER BY h, doc_id::VARCHAR LIMIT 40")
def random_rows(spark, sf):
    return sampling.random_rows(docs_as_messages(spark, sf), 40, "c").select("record_id")


@query("""WITH s AS (SELECT doc_id::VARCHAR AS record_id, lang, md5('42|' || doc_id::VARCHAR) AS h FROM documents), n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang), t AS (SELECT count(*) AS total, ceil(count(*) * 0.15) AS t, ceil((count(*) - ceil(count(*) * 0.15)) * (0.15 / 0.85) - 1e-9) AS v FROM s),
c AS (SELECT lang, n, sum(n) OVER (ORDER BY lang) AS z, sum(n) OVER (ORDER BY lang) - n AS a FROM n), q AS (SELECT lang, round_even(t * z / total, 0) - round_even(t * a / total, 0) AS tq, round_even(v * z / total, 0) - round_even(v * a / total, 0) AS vq FROM c, t),
r AS (SELECT record_id, s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY h, record_id) AS k, tq, vq FROM s JOIN q USING (lang)) SELECT record_id, lang, CASE WHEN k <= tq THEN 'test' WHEN k <= tq + vq THEN 'validation' ELSE 'train' END AS split FROM r""")
def train_val_test_split(spark, sf):
    m = docs_as_messages(spark, sf).select("record_id", F.col("region").alias("lang"))
    return sampling.stratified_split(m, "lang").select("record_id", "lang", "split")


@query("WITH n AS (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS lang), c AS (SELECT lang, count(*) AS cnt FROM documents GROUP BY lang) SELECT n.lang, coalesce(cnt, 1)::BIGINT AS cnt, round_even(sqrt((SELECT count(*) FROM documents) / coalesce(cnt, 1)) / 5, 4) AS weight FROM n LEFT JOIN c USING (lang)")
def class_weights(spark, sf):
    return sampling.class_weights(table(spark, sf, "documents"), "lang", ["de", "en", "es", "fr", "xx"])


# Taxonomy, clusters, exports, labelling

SCHEME: taxonomy.Scheme = [("metal", ["STEEL", "BRASS", "COPPER"]), ("bright", ["POLISHED", "BURNISHED"]), ("small", ["SMALL"])]


@query("SELECT CASE WHEN p_type LIKE '%STEEL%' OR p_type LIKE '%BRASS%' OR p_type LIKE '%COPPER%' THEN 'metal' WHEN p_type LIKE '%POLISHED%' OR p_type LIKE '%BURNISHED%' THEN 'bright' WHEN p_type LIKE '%SMALL%' THEN 'small' END AS class, count(*)::BIGINT AS cnt FROM part GROUP BY 1")
def keyword_scheme(spark, sf):
    return table(spark, sf, "part").groupBy(taxonomy.keyword_class(F.col("p_type"), SCHEME).alias("class")).agg(F.count("*").alias("cnt"))


@query("SELECT CASE WHEN n_name IN ('NATION_3', 'NATION_4') THEN 'near' WHEN n_name LIKE '%N_1%' THEN 'in' ELSE 'rest' END AS class, n_name AS label FROM nation")
def open_label_map(spark, sf):
    return taxonomy.map_labels(table(spark, sf, "nation").select(F.col("n_name").alias("label")), {"far": ["NATION_3"], "near": ["NATION_4", "NATION_3"]}, [("in", ["N_1"])], "rest").select("class", "label")


_G = "list_distinct(list_concat(list_transform(range(1, length(n_name) + 1), lambda i: substr(n_name, i, 1)), list_transform(range(1, length(n_name)), lambda i: substr(n_name, i, 2))))"


@query(f"WITH g AS (SELECT n_name, {_G} AS g FROM nation), p AS (SELECT x.n_name AS a, y.n_name AS b, len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))) AS sim FROM g x JOIN g y ON x.n_name < y.n_name) SELECT a, b, round(sim, 9) AS sim FROM p WHERE sim > 0.2")
def jaccard_pairs(spark, sf):
    out = cluster.similar_pairs(table(spark, sf, "nation").select(F.col("n_name").alias("label")), 0.2)
    return out.withColumn("sim", F.round("sim", 9))


@query("SELECT label, pos::INT AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def label_centroids(spark, sf):
    c = cluster.label_centroids(table(spark, sf, "embeddings"))
    return c.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("mean"))


@query("SELECT max(cnt) - min(cnt) AS range, round(stddev_samp(cnt), 6) AS stdev, round(stddev_samp(cnt) / avg(cnt), 9) AS cv FROM (SELECT label, count(*) AS cnt FROM embeddings GROUP BY label)")
def class_spread(spark, sf):
    out = taxonomy.spread(table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("cnt")))
    return out.select("range", F.round("stdev", 6).alias("stdev"), F.round("cv", 9).alias("cv"))


@query("WITH t AS (SELECT p_type AS label, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_type) SELECT label, cnt::BIGINT AS cnt FROM t WHERE r <= 40 UNION ALL SELECT NULL, coalesce(sum(cnt), 0)::BIGINT FROM t WHERE r > 40")
def label_head_and_rest(spark, sf):
    return taxonomy.head_and_rest(table(spark, sf, "part").groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("cnt")))


@query(f"WITH {_V} SELECT record_id, CASE category WHEN 'abuse' THEN 0 WHEN 'contact' THEN 1 WHEN 'junk' THEN 2 WHEN 'legal' THEN 3 ELSE -1 END::INT AS spam_type FROM f")
def export_numeric_labels(spark, sf):
    return sinks.numeric_labels(fused(spark, sf), {"abuse": 0, "contact": 1, "junk": 2, "legal": 3})


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN NULL WHEN n_name IN ('NATION_3', 'NATION_8') OR n_nationkey % 4 = 0 THEN n_name ELSE '' END AS category, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE n_nationkey / 100.0::DOUBLE END AS confidence FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_nationkey, CASE WHEN n_name IN ('NATION_3', 'NATION_8') THEN n_name ELSE '' END, n_nationkey / 100.0::DOUBLE FROM nation WHERE n_nationkey % 4 = 0")
def parse_llm_response(spark, sf):
    n = table(spark, sf, "nation")
    body = F.to_json(F.struct(F.col("n_name").alias("category"), (F.col("n_nationkey") / F.lit(100.0)).alias("confidence")))
    k = F.col("n_nationkey") % 4
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit(" "), body)).otherwise("no")
    got = X.parse_label_reply(reply, ["nation_3", "NATION_8"])
    return n.select("n_nationkey", got.alias("g")).select("n_nationkey", "g.category", "g.confidence")


@query("SELECT conv_id, turn, 'Name the kind of this message in a few words. Answer with JSON: category, confidence, reason.' || E'\\n' || 'From: ' || role || E'\\n' || 'Subject: ' || conv_id::VARCHAR || E'\\n' || 'Text: ' || substr(text, 1, 500) AS prompt FROM conversations")
def prompt_build(spark, sf):
    c = table(spark, sf, "conversations")
    rows = c.select(F.to_json(F.struct("conv_id", "turn")).alias("record_id"), F.col("role").alias("from_name"), F.col("conv_id").cast("string").alias("subject"), F.col("text").alias("content"))
    out = labeling.build_prompts(rows)
    return out.select(F.get_json_object("record_id", "$.conv_id").cast("bigint").alias("conv_id"), F.get_json_object("record_id", "$.turn").cast("bigint").alias("turn"), "prompt")


@query("SELECT doc_id::VARCHAR AS record_id, trim(regexp_replace(substr(text, 1, 500), '^\\s+|\\s+$', '', 'g')) AS content, CASE WHEN quality IS NULL THEN '' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS rule_category, CASE WHEN quality IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS rule_confidence FROM documents LEFT JOIN labels USING (doc_id)")
def annotation_rows(spark, sf):
    return sinks.annotation_rows(labelled(spark, sf)).select("record_id", "content", "rule_category", "rule_confidence")


@query("SELECT conv_id, turn, role || ' [SEP] ' || conv_id::VARCHAR || ' [SEP] ' || text AS text FROM conversations")
def model_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.model_text(F.col("role"), F.col("conv_id").cast("string"), F.col("text")).alias("text"))


@query("SELECT count(*)::BIGINT AS total, 0::BIGINT AS errors, count(*) FILTER (WHERE model_cat <> '')::BIGINT AS labelled, count(*) FILTER (WHERE rule_cat <> '')::BIGINT AS with_rule, count(*) FILTER (WHERE rule_cat <> '' AND rule_cat = model_cat)::BIGINT AS agree FROM f".join((f"WITH {_V} ", "")))
def label_stats(spark, sf):
    x = fused(spark, sf).select(F.col("model_cat").alias("llm_category"), F.col("rule_cat").alias("rule_category"), F.lit("").alias("error"))
    return labeling.label_stats(x)


@query("SELECT n_name AS name, n_nationkey AS n FROM nation WHERE n_nationkey >= 10")
def sql_query(spark, sf):
    return M.sql_query(spark, "SELECT n_name AS name, n_nationkey AS n FROM nation_q WHERE n_nationkey >= :least", {"nation_q": table(spark, sf, "nation")}, least=10)


@query()
def balanced_agglomerative(spark, sf):
    labels = table(spark, sf, "part").groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("cnt"))
    return cluster.balanced_groups(labels, 5, 1.0)


@query()
def kmeans_balanced(spark, sf):
    return cluster.balanced_label_clusters(cluster.label_centroids(table(spark, sf, "embeddings")), 5)


@query()
def silhouette(spark, sf):
    c = cluster.label_centroids(table(spark, sf, "embeddings"))
    return spark.createDataFrame([(cluster.label_silhouette(c, cluster.balanced_label_clusters(c, 3)),)], "silhouette double")


@query()
def pca_kmeans(spark, sf):
    x = cluster.project(table(spark, sf, "embeddings"))
    return cluster.kmeans(x.select("vec_id", F.col("projected").alias("embedding")), 5).groupBy("cluster").agg(F.count("*").alias("cnt"))


@query()
def lr_train_predict(spark, sf):
    from siftline.operators import model

    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    parts = sampling.stratified_split(rows, "label", key="doc_id")
    fitted = model.train(parts.where("split = 'train'").select("text", "label"))
    return model.predictor(fitted)(parts.where("split = 'test'").select("doc_id", "label", "text")).drop("text")


from siftline.plans import reports  # noqa: E402, F401  registers its queries
