"""Principal components, k-means, and feature ranking by logistic regression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.filters import reindex


def dense_vectors(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell, vec): each cell's values of the chosen genes, in the order of gene ids, zeros filled."""
    wanted = genes.select("gene").agg(F.sort_array(F.collect_set("gene")).alias("order"))
    chosen = counts.join(genes.select("gene"), "gene", "left_semi")
    maps = chosen.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("gene", "v"))).alias("m"))
    rows = cells.select("cell").join(maps, "cell", "left").join(F.broadcast(wanted))
    values = F.transform("order", lambda g: F.coalesce(F.try_element_at(F.col("m"), g), F.lit(0.0)))
    return rows.select("cell", values.alias("vec"))


def covariance(vectors: DataFrame) -> DataFrame:
    """(i, j, cov): sample covariances of the vectors' components."""
    each = vectors.select("cell", F.posexplode("vec").alias("i", "x"))
    other = vectors.select(F.col("cell"), F.posexplode("vec").alias("j", "y"))
    return each.join(other, "cell").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def fit_pca(vectors: DataFrame, n_components: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (features by components) and shares of variance. The largest loading of each component is positive."""
    first = vectors.select(F.size("vec")).first()
    if first is None:
        raise ValueError("no vectors to fit")
    model = PCA(k=min(n_components, first[0]), inputCol="features", outputCol="scores").fit(vectors.select(array_to_vector("vec").alias("features")))
    mean = np.array([r[0] for r in vectors.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").select("m").collect()])
    components = model.pc.toArray()
    sign = np.sign(components[np.abs(components).argmax(axis=0), range(components.shape[1])])
    return mean, components * np.where(sign == 0, 1, sign), model.explainedVariance.toArray()


def pca_scores(vectors: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(cell, vec): scores of the centred vectors."""
    mean, components, _ = model

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(mean))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list((x - mean) @ components), pa.list_(pa.float64()))], ["cell", "vec"])

    return vectors.select("cell", "vec").mapInArrow(project, "cell long, vec array<double>")


def pca(vectors: DataFrame, n_components: int = 50) -> DataFrame:
    return pca_scores(vectors, fit_pca(vectors, n_components))


def pca_on_first(vectors: DataFrame, n_components: int = 50, train_ratio: float = 0.35) -> DataFrame:
    """Scores of all vectors by components of the first part of them, in the order of cell ids."""
    n = vectors.count()
    first = reindex(vectors.select("cell"), "cell").where(F.col("position") < math.ceil(train_ratio * n))
    return pca_scores(vectors, fit_pca(vectors.join(first.select("cell"), "cell", "left_semi"), n_components))


def leading(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.select("cell", F.slice("vec", 1, n).alias("vec"))


def kmeans(vectors: DataFrame, k: int = 35, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """(cell, kmeans): k-means labels as strings."""
    rows = vectors.select("cell", array_to_vector("vec").alias("features")).cache()
    model = KMeans(k=k, seed=seed, maxIter=max_iter, initMode="k-means||", predictionCol="label").fit(rows)
    return model.transform(rows).select("cell", F.col("label").cast("string").alias("kmeans"))


def select_groups(labels: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(group, ord): the groups of `labels` (cell, group) in order of name, or the given ones; two stay in the order given."""
    found = labels.select("group").distinct()
    if groups is None:
        return found.withColumn("ord", F.row_number().over(Window.orderBy("group")).cast("long") - 1)
    wanted = sorted(groups) if len(groups) > 2 else groups
    known = found.where(F.col("group").isin(wanted))
    return known.withColumn("ord", F.array_position(F.array(*map(F.lit, wanted)), F.col("group")).cast("long") - 1)


def rank_features(vectors: DataFrame, labels: DataFrame, groups: list[str] | None = None, reference: str = "rest", n_features: int | None = None, penalty: bool = True, c: float = 1.0, max_iter: int = 100) -> DataFrame:
    """(group, rank, feature, score): features by their coefficients in a multinomial logistic regression on the groups.

    feature is a position in the vectors. `reference` other than `rest` must be a group and joins
    the fit; it does not change what is scored. Two groups get opposite scores.
    """
    chosen = None if groups is None else [*groups, *([reference] if reference != "rest" and reference not in groups else [])]
    order = select_groups(labels, chosen).cache()
    names = [r["group"] for r in order.orderBy("ord").collect()]
    if reference != "rest" and reference not in names:
        raise ValueError(f"{reference!r} is not a group")
    if len(names) < 2:
        raise ValueError("ranking needs two groups or more")
    rows = vectors.join(labels, "cell").join(F.broadcast(order), "group").select(array_to_vector("vec").alias("features"), F.col("ord").cast("double").alias("label")).cache()
    n = rows.count()
    fit = LogisticRegression(family="multinomial", standardization=False, regParam=1.0 / (c * n) if penalty else 0.0, maxIter=max_iter).fit(rows)
    coefficients = fit.coefficientMatrix.toArray()
    rows.unpersist()
    if len(names) == 2 and len(coefficients) == 2:
        coefficients = np.stack([coefficients[0] - coefficients[1], coefficients[1] - coefficients[0]]) / 2
    table = pd.DataFrame({"group": np.repeat(names, coefficients.shape[1]), "feature": np.tile(np.arange(coefficients.shape[1]), len(names)), "score": coefficients.ravel()})
    scores = vectors.sparkSession.createDataFrame(table, "group string, feature long, score double")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "feature")).cast("long"))
    kept = ranked if groups is None else ranked.where(F.col("group").isin(groups))
    return (kept if n_features is None else kept.where(F.col("rank") <= n_features)).select("group", "rank", "feature", "score")
