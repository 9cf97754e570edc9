"""The model's counts of n-grams are those of Spark ML's stages, and each training text is read into them once."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from siftline.operators import model

ODD = ["", "a", "ab", "abc", "ABCabc", "aaaa", "é\U0001f600x \U0001f600", "İıſKΣΑΣ ΑΣ", "发票 发票", "a\x00b\n\tc", "Straße ǅ", "é" * 500 + "ab"]


@pytest.mark.parametrize("n, features", [(1, 64), (2, 1 << 16), (3, 1 << 16), (3, 1000), (4, 1 << 10), (5, 1 << 10)])
def test_counts_are_those_of_the_stages(spark, n, features):
    rows = spark.createDataFrame([(x,) for x in ODD], "text string").coalesce(2)
    stages = model.pipeline(ngram=n, features=features).getStages()
    want = [r[0] for r in PipelineModel(stages[1:4]).transform(rows).select("_tf").collect()]
    assert [r[0] for r in model.with_counts(rows, stages).select("_tf").collect()] == want


def test_chunks(spark, monkeypatch):
    from siftline.functions import ngrams

    texts = ["abcd", "", "xyz", "abcabc"]
    whole = ngrams._vectors(next(ngrams._chunks(texts)), 3, 1 << 10).to_pylist()
    monkeypatch.setattr(ngrams, "CHUNK", 5)
    assert [x for part in ngrams._chunks(texts) for x in ngrams._vectors(part, 3, 1 << 10).to_pylist()] == whole


def test_texts_are_read_once(spark):
    """Training ran over the texts once for each fitted stage and pass; now they are read once into counts."""
    read = spark.sparkContext.accumulator(0)

    def seen(t):
        read.add(1)
        return t

    texts = [("buy now cheap", "ad"), ("meeting at noon", "work")] * 6
    rows = spark.createDataFrame(texts, "text string, label string").coalesce(1).withColumn("text", F.udf(seen)("text"))
    fitted = model.train(rows, features=1 << 10, iterations=3)
    assert len(fitted.stages) == 6 and read.value == len(texts)


def test_same_model_as_the_whole_pipeline(spark):
    rows = spark.createDataFrame([("buy now cheap", "ad"), ("buy cheap sale", "ad"), ("meeting at noon", "work"), ("noon meeting room", "work")] * 5, "text string, label string").coalesce(1)
    got, want = model.train(rows, features=1 << 10, iterations=5), model.pipeline(features=1 << 10, iterations=5).fit(rows)
    assert got.stages[4].idf == want.stages[4].idf and got.stages[5].coefficientMatrix.toArray() == pytest.approx(want.stages[5].coefficientMatrix.toArray(), abs=1e-9)
    probability = [[tuple(r) for r in m.transform(rows).select("prediction").collect()] for m in (got, want)]
    assert probability[0] == probability[1]


def test_null_texts(spark):
    rows = spark.createDataFrame([("buy", "ad"), (None, "work")] * 3, "text string, label string")
    out = model.predictor(model.train(rows, features=64, iterations=2))(rows.select("text"))
    assert out.count() == 6
