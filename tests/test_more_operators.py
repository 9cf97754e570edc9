"""Readers, writers, reports and operators that registered queries do not reach, and the published confusion matrices."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import cluster, evaluate, labeling, model, propagate, sampling, search, store, taxonomy
from siftline.sources import messages as M
from siftline.sources import sinks


def one(df):
    return [tuple(r) for r in df.collect()]


# The two printed confusion matrices (rows: truth, columns: prediction) and the figures that follow from them.
MATRICES = [
    ([[121, 1, 2, 0, 0], [2, 42, 7, 0, 2], [2, 2, 47, 2, 0], [0, 3, 0, 75, 0], [0, 1, 1, 0, 49]], 0.93036, 0.91570, None),
    ([[324, 1, 2, 0, 0], [8, 118, 6, 3, 1], [1, 5, 145, 1, 2], [1, 4, 1, 215, 0], [1, 4, 1, 0, 153]], 0.95787, 0.94933, 90.588),
]


@pytest.mark.parametrize(("cells", "accuracy", "f1", "iou"), MATRICES)
def test_published_matrices(spark, cells, accuracy, f1, iou):
    names = [f"c{k}" for k in range(5)]
    m = spark.createDataFrame([(names[i], names[j], n) for i, row in enumerate(cells) for j, n in enumerate(row)], "truth string, pred string, cnt long")
    got = evaluate.scores(m, names).first()
    assert got.accuracy == pytest.approx(accuracy, abs=1e-5) and got.macro_f1 == pytest.approx(f1, abs=1e-5)
    assert iou is None or got.iou_score == pytest.approx(iou, abs=1e-3)


def test_urls(spark):
    texts = ["see http://a.b/c?x=<1> and foo.bar!", 'q "www.x.org" y', "é.com a.1 a.b1 1.ab", "x http://n.b z", None, "https://", "a..bc/d e@f.gh"]
    got = [r[0] for r in one(spark.createDataFrame([(t,) for t in texts], "t string").select(X.extract_urls(F.col("t"))))]
    assert got == [["http://a.b/c?x=<1>", "foo.bar!"], ['www.x.org"'], ["1.ab"], ["http://n.b"], [], ["https://"], ["a..bc/d", "e@f.gh"]]


def test_label_files(spark, tmp_path):
    rows = '{"record_id": "1", "spam_type": 2}\n\n{"record_id": "1", "spam_type": "03"}\n{"record_id": "2", "spam_type": "x"}\n'
    for name, text in (("a.jsonl", rows), ("a.txt", rows), ("b.csv", "record_id,spam_type\n1,3\n2,x\n"), ("b", "record_id,spam_type\n1,3\n2,x\n")):
        (tmp_path / name).write_text(text)
        assert one(M.read_labels(spark, str(tmp_path / name)).orderBy("record_id")) == [("1", "3"), ("2", "x")], name
    (tmp_path / "k").write_text('{"id": "1", "kind": "z"}\n')
    assert one(M.read_labels(spark, str(tmp_path / "k"), "kind", "id")) == [("1", "z")]
    got = M.read_rows(spark, str(tmp_path / "a.jsonl"), "record_id string, spam_type string", 2)
    assert [r.record_id for r in got.collect()] == ["1", "1"] and M.read_rows(spark, str(tmp_path / "a.jsonl"), "record_id string").count() == 3


def test_labelled_files(spark, tmp_path):
    line = lambda i, c, e="": json.dumps({"record_id": i, "llm_category": c, "error": e}) + "\n"
    (tmp_path / "x_labeled.jsonl").write_text(line("1", "a") + line("2", "b", "timeout") + line("1", "c"))
    (tmp_path / "y_labelled.jsonl").write_text(line("3", "d") + line("1", "z"))
    (tmp_path / "cluster_labeled.jsonl").write_text(line("9", "q"))
    assert sorted((r.record_id, r.llm_category) for r in M.read_labelled(spark, str(tmp_path)).collect()) == [("1", "a"), ("2", "b"), ("3", "d")]
    assert sorted(r.record_id for r in M.read_open_labels(spark, str(tmp_path / "x_labeled.jsonl")).collect()) == ["1", "1"]
    assert sinks.labelled_name("/a.b/rows.jsonl") == "/a.b/rows_labeled.jsonl" and sinks.labelled_name("/a.b/rows") == "/a.b/rows_labeled"
    out = sinks.write_labelled(spark.createDataFrame([("1", None)], "record_id string, llm_category string"), str(tmp_path / "z" / "rows.jsonl"))
    assert out.endswith("rows_labeled.jsonl") and spark.read.json(out).columns == ["llm_category", "record_id"]


def test_open_label_groups(spark):
    rows = spark.createDataFrame([(str(i), "ab"[i % 3 == 0], i) for i in range(9)] + [("x", "", 9), ("y", None, 10)], "record_id string, llm_category string, seq long")
    assert one(M.open_label_groups(rows, 2)) == [("a", 6, ["1", "2"]), ("b", 3, ["0", "3"])]


def test_rule_set(spark):
    held = M.default_rules()
    assert len(held) >= 70 and {r[0] for r in held} == {"content", "subject"} and all(0 < r[3] <= 1 and r[4] for r in held)


def test_tables(spark, tmp_path, parsed=None):
    m, _ = M.parse_lines(spark.createDataFrame([('1\t{"subject": "s", "size": 4}',), ('2\t{"content": "c"}',)], "value string"))
    sinks.write_table(m, str(tmp_path / "t"))
    sinks.write_table(m, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    sinks.write_table(m, str(tmp_path / "t"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    for _ in range(2):  # again does no harm
        sinks.create_table(spark, "siftline_messages", str(tmp_path / "c"))
    assert spark.table("siftline_messages").columns[:2] == ["record_id", "mid"] and spark.table("siftline_messages").count() == 0
    spark.sql("DROP TABLE siftline_messages")
    sinks.write_jsonl(m.select("record_id", "timestamp"), str(tmp_path / "j"))
    assert '"timestamp":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert [r.record_id for r in store.by_id(m, "2").collect()] == ["2"] and store.first_rows(m, 0).count() == 2 and store.first_rows(m, 1).count() == 1


def test_strategies(spark, tmp_path):
    res = lambda c: [{"record_id": "1", "category": c, "confidence": 0.5, "source": "s"}]
    (tmp_path / "s.json").write_text(json.dumps({"total": 1, "results": {"rule": res("a"), "bert": res("b"), "fused": res("b")}}))
    got = M.read_strategies(spark, str(tmp_path / "s.json"))
    assert sorted((r.strategy, r.seq, r.category) for r in got.collect()) == [("bert", 0, "b"), ("fused", 0, "b"), ("rule", 0, "a")]
    for name in ("rule", "bert"):
        sinks.write_strategies(got.where(F.col("strategy") == name), str(tmp_path / "w"))
    assert sorted(r.strategy for r in spark.read.parquet(str(tmp_path / "w")).collect()) == ["bert", "rule"]


def test_split_dataset(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"t{i}", "ab"[i % 4 == 0]) for i in range(80)] + [(f"n{i}", "", None) for i in range(20)], "record_id string, text string, label string")
    sinks.write_split_dataset(rows, str(tmp_path / "d"), ["a", "b", "c"])
    got, labels, weights = M.read_split_dataset(spark, str(tmp_path / "d"))
    assert labels == {"a": 0, "b": 1, "c": 2} and weights["c"] > weights["b"] > weights["a"]
    counts = {(r.split, r.label): r.cnt for r in sampling.split_distribution(got, "label").collect()}
    assert sum(counts.values()) == 100 and sum(n for (s, _), n in counts.items() if s == "test") == 15
    assert sum(n for (_, c), n in counts.items() if c is None) == 20  # null labels are kept, as a label of their own


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("buy now cheap", "ad"), ("buy cheap sale", "ad"), ("meeting at noon", "work"), ("noon meeting room", "work")] * 5, "text string, label string")
    fitted = model.train(rows, sampling.class_weights(rows, "label", ["ad", "work"]), features=1 << 10, iterations=5)
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    want, got = ([(r.text, r.model_cat, round(r.model_conf, 9)) for r in model.predictor(m)(rows.select("text")).collect()] for m in (fitted, again))
    assert want == got and {c for _, c, _ in got} == {"ad", "work"}
    assert {r.model_cat for r in model.predicted_label(again, rows).collect()} == {"ad", "work"}


def test_preview(spark):
    labels = spark.createDataFrame([("bank fraud", 9), ("bank loan", 4), ("casino", 5), ("misc", 7), ("other", 1)], "label string, cnt long")
    got = taxonomy.preview(labels, [("money", ["bank"]), ("play", ["casino"])], examples=1)
    assert sorted(one(got["distribution"])) == [("money", 13, 2), ("play", 5, 1)] and [r.label for r in got["unmapped"].collect()] == ["misc", "other"]
    assert [r.label for r in got["examples"].orderBy("class").collect()] == ["bank fraud", "casino"]


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(propagate, "HOT_ROWS", 5)
    rows = [(i, "hot" if i % 3 else f"k{i}", "c" if i % 2 else "", str(i)) for i in range(90)] + [(99, None, "", "99")]
    m = spark.createDataFrame(rows, "seq long, ip string, category string, record_id string")
    keys = propagate.fit_keys(m)
    got = {r.record_id: (r.key_category, r.key_confidence) for r in propagate.predict(m, keys).collect()}
    monkeypatch.setattr(propagate, "HOT_ROWS", 10**9)
    assert got == {r.record_id: (r.key_category, r.key_confidence) for r in propagate.predict(m, keys).collect()}
    assert len(got) == 91 and got["1"][0] == "c" and got["99"] == ("", 0.0)


def test_similar_pairs(spark):
    names = ["invoice", "invoices", "voice", "casino", "casinos", "cas", "z", "in", "oi", ""]
    df = spark.createDataFrame([(n,) for n in names], "label string")
    grams = {n: set(n) | {n[i : i + 2] for i in range(len(n) - 1)} for n in names}
    sim = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in names for b in names if a < b and grams[a] | grams[b]}
    for least in (0.0, 0.2, 0.5, 0.8):
        assert {(r.a, r.b): pytest.approx(r.sim) for r in cluster.similar_pairs(df, least).collect()} == {k: v for k, v in sim.items() if v > least}
    assert [(r.a, r.b) for r in cluster.top_pairs(df, 2, 0.1).collect()] == sorted(sim, key=lambda k: (-sim[k], k))[:2]
    with pytest.raises(ValueError, match="more than"):
        cluster.similar_pairs(spark.range(cluster.MOST_LABELS + 1).select(F.col("id").cast("string").alias("label")))


def test_silhouette_blocks():
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(70, 5)), rng.integers(0, 4, 70)
    c[0] = 9
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    want = []
    for i in range(70):
        own = [j for j in range(70) if c[j] == c[i] and j != i]
        b = min(d[i, c == k].mean() for k in set(c.tolist()) - {c[i]})
        a = d[i, own].mean() if own else 0
        want.append((b - a) / max(a, b) if own else 0)
    assert cluster.silhouette(x, c, block=16) == pytest.approx(np.mean(want))


def test_search_binds_tokens(spark):
    """The text is split once per field, not once for each place: no split stands inside the loop over places."""
    df = search.search(spark.createDataFrame([(1, "a b the c"), (2, "the the")], "seq long, subject string"), "the", ["subject"], limit=1, offset=1)
    assert [r.seq for r in df.collect()] == [1]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    loop = plan[plan.index("sequence(") :]
    assert "split(" not in loop[: loop.index("lambdafunction", 1)]


class Service(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.asked.append((self.headers.get("Authorization"), self.headers.get("x-api-key"), body["messages"][0]["content"]))
        if len(Service.asked) == 1:
            self.send_response(429)
            self.end_headers()
            return
        if body["messages"][0]["content"] == "bad":
            self.send_response(400)
            self.end_headers()
            return
        text = '{"category": "a", "confidence": 0.5}'
        answer = {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}} if self.path == "/chat" else {"content": [{"text": text}], "usage": {"input_tokens": 7, "output_tokens": 3}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


@pytest.mark.parametrize("style", ["chat", "messages"])
def test_http_labeller(spark, monkeypatch, style):
    monkeypatch.setenv("LABELLER_KEY", "k")
    Service.asked = []
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    make = labeling.http_labeller(f"http://127.0.0.1:{server.server_port}/{style}", "m", "LABELLER_KEY", style)
    with pytest.raises(labeling.Busy):
        make()(["x"])
    assert make()(["x"]) == [('{"category": "a", "confidence": 0.5}', 7, 3)]
    with pytest.raises(OSError):
        make()(["bad"])
    assert Service.asked[1][0 if style == "chat" else 1] in ("Bearer k", "k")
    prompts = spark.createDataFrame([("1", "hello")], "record_id string, prompt string")
    got = labeling.label_rows(prompts, make, 0.1, 0.2).first()
    server.shutdown()
    assert got.error == "" and got.cost == pytest.approx(1.3)
