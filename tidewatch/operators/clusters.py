"""Clusters of document vectors with MLlib: principal components, then bisecting or plain k-means by cosine."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_docs(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, dimensions: int = 8, seed: int = 42, least: int = 5) -> DataFrame:
    """(key, cluster): clusters of fewer than ``least`` members are noise, -1. Null vectors go."""
    rows = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    stages = [Normalizer(inputCol="v", outputCol="u"), PCA(k=dimensions, inputCol="u", outputCol="p"), KMeans(featuresCol="p", predictionCol="cluster", k=k, seed=seed, maxIter=20)]
    found = Pipeline(stages=stages).fit(rows).transform(rows).select(key, "cluster")
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(sizes), "cluster").select(key, F.when(F.col("n") >= least, F.col("cluster")).otherwise(-1).alias("cluster"))  # k rows


def sweep(vectors: DataFrame, sizes: list[int], vector: str = "embedding", **options) -> DataFrame:
    """(k, silhouette) for each number of clusters."""
    rows = vectors.where(F.col(vector).isNotNull()).withColumn("v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    out = [(k, float(ClusteringEvaluator(featuresCol="v").evaluate(KMeans(featuresCol="v", k=k, seed=42, maxIter=20).fit(rows).transform(rows)))) for k in sizes]
    return vectors.sparkSession.createDataFrame(out, "k int, silhouette double")
