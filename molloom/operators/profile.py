"""Histograms, clusters and neighbour graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: Column, low: float, high: float, n_ticks: int) -> DataFrame:
    """(bin, n) over the bins between n_ticks - 1 ticks from low, high - low over n_ticks - 1 apart; the last bin holds
    its right end, values outside are dropped. Empty bins have no row."""
    step = (high - low) / (n_ticks - 1)
    last = n_ticks - 3
    top = low + step * (last + 1)
    bin_ = F.when(value == top, last).otherwise(F.floor((value - low) / step)).cast("long")
    return df.where((value >= low) & (value <= top)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def extremes(df: DataFrame, cluster: str, value: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.min(value).alias("least"), F.max(value).alias("most"))


def medoids(df: DataFrame, cluster: str, row: str, vector: str, centres: DataFrame | None = None) -> DataFrame:
    """(cluster, medoid, distance): of each cluster the row nearest to its centre (by default the mean), ties by row."""
    if centres is None:
        each = df.select(cluster, F.posexplode(vector).alias("i", "x"))
        mean = each.groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        centres = mean.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("__c")).select(cluster, F.transform("__c", lambda s: s["x"]).alias("centre"))
    apart = F.aggregate(F.zip_with(vector, "centre", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, b: a + b)
    near = df.join(centres, cluster).withColumn("__d", F.round(F.sqrt(apart), 6))
    return near.groupBy(cluster).agg(F.min(F.struct("__d", row)).alias("__m")).select(cluster, F.col("__m")[row].alias("medoid"), F.col("__m")["__d"].alias("distance"))


def knn_graph(scored: DataFrame, query: str, row: str, score: str, k: int = 25) -> DataFrame:
    """The k nearest rows of each query beside itself, with their number from 1."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), row)
    return scored.where(F.col(query) != F.col(row)).withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= k)


def embed(df: DataFrame, vector: str, dimensions: int = 2) -> DataFrame:
    """Adds x, y, ... by principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    out = PCA(k=dimensions, inputCol="__v", outputCol="__p").fit(rows).transform(rows)
    names = ["x", "y", *(f"x{k}" for k in range(3, dimensions + 1))][:dimensions]
    return out.withColumns({n: vector_to_array("__p")[k] for k, n in enumerate(names)}).drop("__v", "__p")
