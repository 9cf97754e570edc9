"""Clustering of free labels: bigram similarity, embeddings, balanced agglomeration and balanced k-means."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.text import char_bigrams, jaccard

#: Distinct labels that the driver-side loops take (a matrix of 72 MB and its copy); more are an error.
MOST_LABELS = 3000


def similar_pairs(labels: DataFrame, least: float = 0.0) -> DataFrame:
    """a, b, sim of every two labels (a < b) that share a bigram, with their Jaccard similarity above `least`.

    Labels meet on their rarest bigrams only, as many as a pair above `least` must share one of, so a common letter brings nothing
    together. With `least` 0 that is all bigrams, and labels are checked to be no more than MOST_LABELS.
    """
    from pyspark.sql.window import Window

    grams = labels.select("label").distinct().withColumn("g", char_bigrams(F.col("label")))
    if least <= 0:
        _bounded(grams.select("label"))
    each = grams.select("label", "g", F.explode("g").alias("x"))
    rare = each.join(each.groupBy("x").agg(F.count("*").alias("c")), "x").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("c", "x")))
    first = rare.where(F.col("r") <= F.size("g") - F.ceil(F.size("g") * max(0.0, least) - 1e-9) + 1).select("label", "g", "x")
    left, right = first.select(F.col("label").alias("a"), "x", F.col("g").alias("ga")), first.select(F.col("label").alias("b"), "x", F.col("g").alias("gb"))
    both = left.join(right, "x").where("a < b").dropDuplicates(["a", "b"])
    return both.select("a", "b", jaccard(F.col("ga"), F.col("gb")).alias("sim")).where((F.col("sim") > least) & (F.col("sim") > 0))


def top_pairs(labels: DataFrame, n: int = 20, least: float = 0.0) -> DataFrame:
    """The n most similar pairs; ties in the order of the labels."""
    return similar_pairs(labels, least).orderBy(F.desc("sim"), "a", "b").limit(n)


def similarity(a, b):
    return jaccard(char_bigrams(a), char_bigrams(b))


def _bounded(rows: DataFrame, most: int = MOST_LABELS) -> list:
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows for a loop on the driver")
    return got


def balanced_groups(labels: DataFrame, k: int = 5, beta: float = 1.0) -> DataFrame:
    """label, cluster, name: agglomeration of labels (label, cnt) that weighs single-link similarity by how near the merged size is
    to an even share. If no pair scores, the two smallest clusters merge. A cluster is named after its most frequent label.

    Similarities come from Spark; the loop over at most MOST_LABELS labels runs on the driver.
    """
    rows = sorted(((r["label"], r["cnt"]) for r in _bounded(labels.select("label", "cnt"))), key=lambda r: (-r[1], r[0]))
    names = [r[0] for r in rows]
    at = {n: i for i, n in enumerate(names)}
    sim = np.zeros((len(names), len(names)))
    for r in similar_pairs(labels).toLocalIterator():
        sim[at[r["a"]], at[r["b"]]] = sim[at[r["b"]], at[r["a"]]] = r["sim"]
    size = np.array([r[1] for r in rows], float)
    of, alive = np.arange(len(names)), np.ones(len(names), bool)
    target = size.sum() / max(1, k)
    while alive.sum() > k:
        live = np.flatnonzero(alive)
        merged = size[live][:, None] + size[live][None, :]
        factor = 1 - beta * np.abs(merged / target - 1)
        score = np.where(factor > 0, sim[np.ix_(live, live)] * factor, -1.0)
        np.fill_diagonal(score, -1.0)
        i, j = np.unravel_index(score.argmax(), score.shape)
        if score[i, j] <= 0:
            i, j = np.argsort(size[live], kind="stable")[:2]
        i, j = sorted((int(live[i]), int(live[j])))
        of[of == j] = i
        size[i] += size[j]
        sim[i] = np.maximum(sim[i], sim[j])
        sim[:, i] = sim[i]
        alive[j] = False
    schema = "label string, cluster int, name string"
    return labels.sparkSession.createDataFrame([(n, int(c), names[c]) for n, c in zip(names, of.tolist(), strict=True)], schema)


def label_centroids(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, n, centroid: mean vector of each label; partial sums map-side, so a hot label costs no more."""
    from pyspark.ml.stat import Summarizer

    means = rows.groupBy(label).agg(F.count("*").alias("n"), Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m"))
    return means.select(label, "n", vector_to_array("m").alias("centroid"))


def project(rows: DataFrame, dims: int = 64, vector: str = "embedding") -> DataFrame:
    """rows with `projected`: the first principal components of the centred vectors."""
    x = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    n, d = x.agg(F.count("*"), F.max(F.size(vector))).first()
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(x).transform(x)
    out = PCA(k=max(1, min(dims, n - 1, d)), inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    return out.withColumn("projected", vector_to_array("_p")).drop("_v", "_c", "_p")


def kmeans(rows: DataFrame, k: int = 5, seeds: int = 10, vector: str = "embedding") -> DataFrame:
    """rows with cluster, of the best of several seeded runs by training cost."""
    x = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    held = x.select("_v").cache()
    models = [KMeans(k=k, seed=42 + s, featuresCol="_v", predictionCol="cluster").fit(held) for s in range(seeds)]
    held.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost).transform(x).drop("_v")


def balanced_kmeans(points: np.ndarray, weights: np.ndarray, start: np.ndarray, slack: float = 0.3, steps: int = 100) -> np.ndarray:
    """Clusters of weighted points that start from centres `start`: while the largest cluster outweighs the smallest by more than
    `slack` of an even share, the point that loses least moves from the largest to the smallest."""
    k = len(start)
    of = ((points[:, None] - start[None]) ** 2).sum(-1).argmin(1)
    target = weights.sum() / k
    for _ in range(steps):
        size = np.bincount(of, weights, k)
        big, small = int(size.argmax()), int(size.argmin())
        if (size[big] - size[small]) / target < slack or (of == big).sum() <= 1:
            break
        centres = np.stack([np.average(points[of == c], axis=0, weights=weights[of == c]) if (of == c).any() else start[c] for c in range(k)])
        own = np.flatnonzero(of == big)
        loss = np.linalg.norm(points[own] - centres[small], axis=1) - np.linalg.norm(points[own] - centres[big], axis=1)
        of[own[loss.argmin()]] = small
    return of


def balanced_label_clusters(centroids: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """label, cluster of label centroids (label, n, centroid), weighted by n; the loop over labels runs on the driver."""
    rows = sorted(_bounded(centroids.select("label", "n", "centroid")), key=lambda r: r["label"])
    x, w = np.array([r["centroid"] for r in rows]), np.array([r["n"] for r in rows], float)
    k = min(k, len(rows))
    start = x[np.random.default_rng(seed).choice(len(rows), k, replace=False)] if k else x
    of = balanced_kmeans(x, w, start) if k else []
    field = centroids.schema["label"]
    schema = T.StructType([T.StructField("label", field.dataType), T.StructField("cluster", T.IntegerType())])
    return centroids.sparkSession.createDataFrame([(r["label"], int(c)) for r, c in zip(rows, of, strict=True)], schema)


def silhouette(points: np.ndarray, clusters: np.ndarray, block: int = 256) -> float:
    """Mean Euclidean silhouette of a few thousand points, `block` rows of distances at a time; 0 for a point alone in its cluster."""
    names, own = np.unique(clusters, return_inverse=True)
    if len(names) < 2:
        return 0.0
    sizes = np.bincount(own)
    member = np.eye(len(names))[own]
    squares = (points**2).sum(1)
    total = 0.0
    for s in range(0, len(points), block):
        part, at = points[s : s + block], own[s : s + block]
        d = np.sqrt(np.maximum(squares[s : s + block, None] + squares[None] - 2 * part @ points.T, 0))
        d[np.arange(len(part)), np.arange(s, s + len(part))] = 0
        sums = d @ member
        rows = np.arange(len(part))
        a = sums[rows, at] / np.maximum(1, sizes[at] - 1)
        other = sums / sizes
        other[rows, at] = np.inf
        b = other.min(1)
        total += float(np.where(sizes[at] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).sum())
    return total / len(points)


def label_silhouette(centroids: DataFrame, clusters: DataFrame) -> float:
    rows = _bounded(centroids.select("label", "centroid").join(clusters.select("label", "cluster"), "label"), 5000)
    return silhouette(np.array([r["centroid"] for r in rows]), np.array([r["cluster"] for r in rows])) if rows else 0.0


def cohesion(clusters: DataFrame, labels: DataFrame, members: int = 15) -> DataFrame:
    """cluster, cohesion: mean similarity of the pairs of a cluster's most frequent labels."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("cluster").orderBy(F.desc("cnt"), "label")
    top = clusters.select("label", "cluster").join(labels.select("label", "cnt"), "label").withColumn("r", F.row_number().over(w)).where(F.col("r") <= members)
    a, b = top.select("cluster", F.col("label").alias("a"), F.col("r").alias("ra")), top.select("cluster", F.col("label").alias("b"), F.col("r").alias("rb"))
    pairs = a.join(b, "cluster").where("ra < rb")
    return pairs.groupBy("cluster").agg(F.avg(similarity(F.col("a"), F.col("b"))).alias("cohesion"))
