"""Edge cases of the message operators, and golden figures."""

import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import cluster, evaluate, fusion, labeling, propagate, rules, sampling, search, store, taxonomy
from siftline.plans import triage
from siftline.sources import messages as M
from siftline.sources import sinks
from siftline.streaming import ingest


def one(df):
    return [tuple(r) for r in df.collect()]


LINES = [
    'a\t{"sender": " S@x.org ", "rcpt": "a@x; ;B@y;", "url": "http://a.com/x foo.bar 1.2 a@b.co", "ip": "999.1.1.1", "size": 12.7, "textsize": " 12 ", "wlistcnt": "12.5", "@timestamp": "2019-10-30T01:00:00"}',
    "",
    "no tab here",
    "b\t{broken",
    "c\t[1, 2]",
    'd\t{"subject": "x\\ty", "size": "12", "url": null}\tmore',
    'a\t{"sender": "second"}',
    'e\t{"size": null, "content": "q\tr", "dwlistcnt": true}',
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "i long, value string").coalesce(1)
    return M.parse_lines(df, F.col("i"))


def test_parse(parsed):
    good, bad = parsed
    rows = {(r.record_id, r.seq): r for r in good.collect()}
    a = rows["a", 0]
    assert (a.size, a.text_size, a.wlist_cnt, a.dwlist_cnt) == (12, 12, 0, 0)
    assert a.parsed_urls == ["http://a.com/x", "foo.bar", "a@b.co"] and a.parsed_ips == ["999.1.1.1"] and a.parsed_rcpts == ["a@x", "B@y"]
    assert rows["e", 7].dwlist_cnt == 1 and rows["e", 7].size == 0 and rows["e", 7].urls == ""
    assert {r.reason for r in bad.collect()} == {"no tab", "no JSON object"}
    assert {r.seq for r in bad.collect()} >= {2, 3, 4}


def test_keep_first(spark, parsed):
    kept = M.keep_first(parsed[0])
    assert sorted(r.seq for r in kept.where("record_id = 'a'").collect()) == [0]
    stored = spark.createDataFrame([("e",)], "record_id string")
    assert "e" not in [r.record_id for r in M.keep_first(parsed[0], stored=stored).collect()]


def test_stats(parsed):
    s = store.log_stats(M.keep_first(parsed[0]))
    assert s["totals"].first().total >= 2
    assert one(s["recipients"]) == [("a@x", 1), ("b@y", 1)]
    assert store.log_stats(parsed[0].limit(0))["totals"].first().total == 0


def test_domain(spark):
    df = spark.createDataFrame([("https://h.org:80/p?q",), ("foo.bar/x",)], "u string")
    assert [r[0] for r in one(df.select(X.url_domain(F.col("u"))))] == ["h.org", "foo.bar"]


def test_range(spark):
    df = spark.createDataFrame([("2019-10-31T00:00:00",), ("2019-10-30T23:59:59",), (None,), ("",)], "timestamp string")
    assert one(store.date_range(df, "2019-10-30", "2019-10-31")) == [("2019-10-30T23:59:59",)]


def test_whitelist(spark):
    df = spark.createDataFrame([("x", 1)], "raw_json string, seq long")
    with pytest.raises(ValueError):
        store.search_by_field(df, "raw_json", "x")
    with pytest.raises(ValueError):
        store.top_values(df, "raw_json")


def test_like_folds_ascii_only(spark):
    df = spark.createDataFrame([(0, "ÄB%c"), (1, "äb"), (2, "xAbc")], "seq long, t string")
    assert [r[0] for r in one(store.search_like(df, "äB", ["t"]))] == [1]
    assert [r[0] for r in one(store.search_like(df, "A_C", ["t"]))] == [2]


RULES = [("content", r"\bAV\b", "x", 0.9, ""), ("subject", "a.c", "y", 0.15, ""), ("content", "p", "z", 0.5, ""), ("content", "q", "w", 0.5, ""), ("content", "p|q", "x", 0.8, "")]


def test_rules(spark):
    rows = [("看AV片", ""), ("看 AV 片", ""), ("", "a\rc"), ("", "a\nc"), ("pq", ""), (None, None)]
    df = spark.createDataFrame(rows, "content string, subject string")
    got = one(rules.classify(df, RULES, ["z", "w"]).select("rule_category", "rule_confidence"))
    assert got == [("", 0.0), ("x", 0.9), ("", 0.15), ("", 0.0), ("x", 0.8), ("", 0.0)]
    tie = one(rules.classify(df.where("content = 'pq'"), RULES[2:4], ["w", "z"]).select("rule_category"))
    assert tie == [("w",)]
    capped = [("content", "p", "z", 0.7, ""), ("content", "q", "z", 0.7, "")]
    assert one(rules.classify(df.where("content = 'pq'"), capped).select("rule_confidence")) == [(1.0,)]
    assert one(rules.classify(df, []).select("rule_category").distinct()) == [("",)]


def test_rules_against_plain_python(spark):
    import random
    import re

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcAB 12.|") for _ in range(rnd.randrange(30))) for _ in range(200)]
    rs = [("content", p, c, w, "") for p, c, w in ((r"a.b", "k", 0.3), (r"[ab]{2}", "l", 0.25), (r"\d\d", "m", 0.15), (r"\bc", "k", 0.6), ("b c", "l", 0.55))]
    got = one(rules.classify(spark.createDataFrame([(t,) for t in texts], "content string"), rs).select("content", "rule_category", "rule_confidence"))
    for t, cat, conf in got:
        score = {}
        for _, p, c, w, _ in rs:
            if re.search(p, t, re.I):
                score[c] = score.get(c, 0.0) + w
        best, top = "", 0.0
        for c in ("k", "l", "m"):
            if min(score.get(c, 0.0), 1.0) > top:
                best, top = c, min(score[c], 1.0)
        assert (cat, conf) == (best if top >= 0.2 else "", pytest.approx(round(top, 3))), t


def test_read_rules(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"field": "content", "pattern": "x", "category": "c", "weight": 0.4}, {"field": "content", "pattern": "y", "category": "d"}]')
    (tmp_path / "a.json").write_text('[{"field": "subject", "pattern": "z", "category": "e", "confidence": 0.9, "reason": "r"}]')
    got = rules.rule_list(M.read_rules(spark, str(tmp_path)))
    assert got == [("subject", "z", "e", 0.9, "r"), ("content", "x", "c", 0.4, ""), ("content", "y", "d", 0.5, "")]


def test_propagation(spark):
    rows = [(i, "big", "a" if i < 10 else "b") for i in range(16)] + [(20, "two", "a"), (21, "two", "a"), (30, "tie", "b"), (31, "tie", "a"), (32, "six", "a"), (33, "six", "a"), (34, "six", "a"), (35, "six", "b"), (36, "six", "b"), (40, "big", ""), (41, "none", None), (42, " ", "a")]
    df = spark.createDataFrame(rows, "seq long, ip string, category string")
    keys = propagate.fit_keys(df)
    assert sorted((r.ip, r.category, round(r.purity, 3), r.n) for r in keys.collect()) == [("big", "a", 0.625, 16), ("six", "a", 0.6, 5)]
    assert one(propagate.propagate(df, keys).select("seq", "category", "confidence")) == [(40, "a", 0.312)]


@pytest.mark.parametrize(("row", "want"), [
    (("a", 0.9, "b", 0.8), ("b", 0.8, "model")), (("a", 0.9, "a", 0.3), ("a", 0.9, "consensus")), (("a", 0.9, "b", 0.6), ("b", 0.5, "model")), (("a", 0.9, "b", 0.5), ("b", 0.4, "model")),
    (("a", 0.7, "b", 0.4), ("a", 0.7, "rule_fallback")), (("a", 0.6, "b", 0.4), ("b", 0.4, "model")), (("a", 0.6, "", 0.0), ("a", 0.6, "rule_fallback")), (("", 0.0, None, 0.9), ("", 0.0, "")),
])
def test_fusion(spark, row, want):
    df = spark.createDataFrame([row], "rule_cat string, rule_conf double, model_cat string, model_conf double")
    got = fusion.fuse_rows(df).select("category", "confidence", "source").first()
    assert (got[0], got[2]) == (want[0], want[2]) and got[1] == pytest.approx(want[1])


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (0.1, 0.2, 0.3, 0.4)], "category string, confidence double")
    assert fusion.confidence_by_category(df).first()["median"] == 0.3


def test_metrics_against_plain_python(spark):
    rng = np.random.default_rng(1)
    names = ["a", "b", "c", "d"]
    truth, pred = rng.integers(0, 4, 300), rng.integers(0, 5, 300)
    rows = [(names[t], names[p] if p < 4 else "other") for t, p in zip(truth, pred)]
    m = evaluate.confusion(spark.createDataFrame(rows, "truth string, pred string"))
    got = evaluate.scores(m, names).first()
    f1, iou = [], []
    for n in names:
        tp, fp, fn = sum(t == p == n for t, p in rows), sum(t != n == p for t, p in rows), sum(t == n != p for t, p in rows)
        f1.append(2 * tp / (2 * tp + fp + fn))
        iou.append(tp / (tp + fp + fn))
    assert got.macro_f1 == pytest.approx(np.mean(f1)) and got.iou_score == pytest.approx(100 * np.mean(iou)) and got.accuracy == pytest.approx(np.mean([t == p for t, p in rows]))
    empty = evaluate.scores(m.limit(0), names).first()
    assert (empty.n, empty.accuracy, empty.macro_f1) == (0, 0.0, 0.0)


def test_class_spread(spark):
    got = taxonomy.spread(spark.createDataFrame([(x,) for x in (8049, 3201, 3737, 5245, 3768)], "cnt long")).first()
    assert round(got["stdev"], 1) == 1968.9 and round(100 * got["range"] / 24000, 1) == 20.2


def test_align_many_to_one(spark):
    cells = [("a", "1", 9), ("b", "1", 8), ("b", "2", 7), ("c", "3", 5), ("a", "4", 4), ("c", "4", 1)]
    assert evaluate.align(spark.createDataFrame(cells, "a string, b string, cnt long")) == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "a")]


def test_split_sizes(spark):
    assert sampling.split_sizes(2388) == (1670, 359, 359)
    df = spark.range(2388).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 5).cast("string").alias("label"))
    got = {r["split"]: r["count"] for r in sampling.stratified_split(df, "label").groupBy("split").count().collect()}
    assert got == {"train": 1670, "validation": 359, "test": 359}


def test_quotas():
    q = sampling.proportional_quotas({"a": 800, "b": 150, "c": 50, "d": 4}, 100)
    assert sum(q.values()) == 100 and q["d"] == 4 and q["c"] == 10
    assert sampling.proportional_quotas({}, 10) == {} and sum(sampling.proportional_quotas({"a": 3, "b": 4}, 2).values()) == 7


def test_samples(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("record_id"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("").alias("category"))
    a = sampling.quota_sample(df, {"x": 10, "y": 200, "": 5}, "s")
    assert {r["category"]: r["count"] for r in a.groupBy("category").count().collect()} == {"x": 10, "y": 100, "": 5}
    b = sampling.quota_sample(df, {"x": 95}, "s", used=a)
    assert b.count() == 90 and b.join(a, "record_id").count() == 0


def test_search_against_sqlite(spark):
    docs = ["the cat sat", "Café on the mat", "cat cat the cat sat on", "发票代开 here", "看AV片", "", "the the cat", "a cat, sat!"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(subject, content)")
    db.executemany("INSERT INTO t(rowid, subject, content) VALUES (?, ?, ?)", [(i, d, docs[-i]) for i, d in enumerate(docs)])
    df = spark.createDataFrame([(i, d, docs[-i]) for i, d in enumerate(docs)], "seq long, subject string, content string")
    for phrase in ("cat sat", "cafe", "the", "发票", "发票代开", "cat*"):
        want = {r: -s for r, s in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", ('"' + phrase + '"',))}
        got = {r.seq: r.score for r in search.search(df, phrase).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want), phrase
    assert search.search(df, " ,").count() == 0 and search.search(df, "zzz").count() == 0


def test_replies(spark):
    replies = ['{"category": " Spam ", "confidence": "0.7"}', '```json\n{"category": "other", "confidence": 1}\n```', "sorry", None, '{"category": null}']
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    got = [r[0] for r in one(df.select(X.parse_label_reply(F.col("r"), ["spam"])))]
    assert [None if g is None else (g.category, g.confidence) for g in got] == [("Spam", 0.7), ("", 1.0), None, None, ("", 0.0)]


def test_labelling(spark):
    def make():
        asked = []

        def labeller(prompts):
            asked.append(1)
            if len(asked) == 1:
                raise labeling.Busy
            return [('{"category": "a", "confidence": 0.9}', 10, 5)] * len(prompts)

        return labeller

    def broken():
        def labeller(prompts):
            raise RuntimeError("down")

        return labeller

    rows = spark.createDataFrame([("1", "f", "s", "c"), ("2", None, None, None)], "record_id string, from_name string, subject string, content string").coalesce(1)
    prompts = labeling.build_prompts(rows, ["a", "b"])
    got = labeling.parsed_labels(labeling.label_rows(prompts, make, 0.1, 0.2, wait=0.01), ["a"]).collect()
    assert [(r.record_id, r.llm_category, r.error) for r in got] == [("1", "a", ""), ("2", "a", "")]
    assert {r.error for r in labeling.label_rows(prompts, broken).collect()} == {"RuntimeError: down"}


def test_exports(spark, tmp_path, parsed):
    labels = sinks.numeric_labels(spark.createDataFrame([("1", "a"), ("2", "zz"), ("3", None)], "record_id string, category string"), {"a": 0})
    assert one(labels) == [("1", 0), ("2", -1), ("3", -1)]
    sinks.write_labels(labels, str(tmp_path / "x"))
    assert one(M.read_labels(spark, str(tmp_path / "x.csv")).orderBy("record_id")) == [("1", "0"), ("2", "-1"), ("3", "-1")]
    assert M.read_labels(spark, str(tmp_path / "x.jsonl")).count() == 3
    sinks.export_csv(parsed[0], str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c")).count() == parsed[0].count()


def test_training_label(spark):
    rows = [("a", 0.0, "b", 0.9), ("", 0.9, "b", 0.5), ("a", 0.5, "", 0.0), ("zz", 0.9, "b", 0.9), (None, None, None, None)]
    df = spark.createDataFrame(rows, "llm_category string, llm_confidence double, rule_category string, rule_confidence double")
    cat, conf, ok = evaluate.training_label(["a", "b"])
    assert one(df.select(cat, conf, ok)) == [("a", 0.9, True), ("b", 0.9, True), ("a", 0.5, True), ("zz", 0.9, False), ("", 0.0, False)]


def test_clusters(spark):
    x = spark.createDataFrame([("invoice", 50), ("invoices", 40), ("casino", 60), ("casinos", 30), ("zz", 20)], "label string, cnt long")
    got = {r.label: r.cluster for r in cluster.balanced_groups(x, 3, 0.5).collect()}
    assert got["invoice"] == got["invoices"] and got["casino"] == got["casinos"] and len(set(got.values())) == 3
    pts = np.array([[0.0], [0.1], [0.2], [5.0]])
    of = cluster.balanced_kmeans(pts, np.ones(4), np.array([[0.0], [5.0]]))
    assert sorted(np.bincount(of).tolist()) == [2, 2]
    assert cluster.silhouette(np.array([[0.0], [0.1], [5.0], [5.1]]), np.array([0, 0, 1, 1])) > 0.9


def test_triage_plan(spark):
    rows = [(i, str(i), "p" if i % 2 else "", "ip", "n") for i in range(12)]
    m = spark.createDataFrame(rows, "seq long, record_id string, content string, ip string, subject string")
    out = triage.triage(m, RULES, ["z"])
    assert {r.final_category for r in out.collect()} == {"x"}
    assert triage.strategies(out).count() == 36


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text('1\t{"size": 3}\nbad\n2\t{"size": 4}\n')
    run = lambda: ingest.ingest_stream(spark, str(src), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    (src / "b.txt").write_text('2\t{"size": 9}\n3\t{"size": 5}\n')
    run()
    got = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.record_id, r.size) for r in got.collect()) == [("1", 3), ("2", 4), ("3", 5)]
