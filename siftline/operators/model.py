"""A pluggable text model: any function from a DataFrame to one with model_cat and model_conf; by default a Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from siftline.functions import ngrams

Predictor = Callable[[DataFrame], DataFrame]
CHARS = "_chars"


def pipeline(features: int = 1 << 16, ngram: int = 3, iterations: int = 50, weight: str | None = None) -> Pipeline:
    """Character n-grams, hashed and weighted by rarity, into multinomial logistic regression."""
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=iterations, regParam=1e-3, family="multinomial")
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="_label", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern="", gaps=True, toLowercase=True, minTokenLength=1),
        NGram(n=ngram, inputCol="_tokens", outputCol="_grams"),
        HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
        lr,
    ])


def with_counts(rows: DataFrame, stages: list) -> DataFrame:
    """rows with `_tf`, as the pipeline's tokens, n-grams and hashed counts (its stages 1 to 3) give it."""
    n, features = stages[2].getN(), stages[3].getNumFeatures()
    if n > ngrams.MOST:
        return PipelineModel(stages[1:4]).transform(rows)
    return rows.withColumn("_tf", ngrams.hashed_ngrams(rows.sparkSession, F.col("text"), n, features))


def train(rows: DataFrame, weights: DataFrame | None = None, **kwargs) -> PipelineModel:
    """Fits the default model to rows (text, label); weights (label, weight) from class_weights(). Texts are read into counts once,
    and these are kept on disk while the weights of n-grams and the classes are fitted."""
    if weights is not None:
        rows = rows.join(F.broadcast(weights.select("label", "weight")), "label")
    stages = pipeline(weight=None if weights is None else "weight", **kwargs).getStages()
    labels, idf, lr = stages[0].fit(rows), *stages[4:]
    own = ["_label", "_tf"] + ([] if weights is None else ["weight"])
    counts = with_counts(labels.transform(rows), stages).select(own).persist(StorageLevel.DISK_ONLY)
    try:
        rarity = idf.fit(counts)
        return PipelineModel([labels, *stages[1:4], rarity, lr.fit(rarity.transform(counts))])
    finally:
        counts.unpersist()


def predictor(model: PipelineModel) -> Predictor:
    """model_cat, model_conf of rows with text: the most probable label and its probability, JVM-side and by partition."""
    labels = model.stages[0].labels
    scored = PipelineModel(model.stages[4:])

    def predict(rows: DataFrame) -> DataFrame:
        own = rows.columns
        out = scored.transform(with_counts(rows.withColumn("text", F.coalesce("text", F.lit(""))), model.stages))
        p = vector_to_array("probability")
        names = F.array(*(F.lit(x) for x in labels))
        best = F.array_max(F.transform(p, lambda x, i: F.struct(x.alias("p"), -i)))
        return out.withColumn("_best", best).select(*own, F.element_at(names, 1 - F.col("_best.col2")).alias("model_cat"), F.col("_best.p").alias("model_conf"))

    return predict


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predicted_label(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return IndexToString(inputCol="prediction", outputCol="model_cat", labels=model.stages[0].labels).transform(out)
