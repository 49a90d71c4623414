"""Fitted models that can be saved, loaded in another session and put into pipelines."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molloom.operators import cluster


class _ClusterParams(Params):
    group = Param(Params._dummy(), "group", "column of the groups (cycles) that are clustered apart", TypeConverters.toString)
    row = Param(Params._dummy(), "row", "column of the rows' ids, long", TypeConverters.toString)
    vector = Param(Params._dummy(), "vector", "column of the vectors", TypeConverters.toString)
    prediction = Param(Params._dummy(), "prediction", "column of the cluster's number", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "clusters of each group", TypeConverters.toInt)
    starts = Param(Params._dummy(), "starts", "starts of which the best stays", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "iterations at most", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of all draws", TypeConverters.toInt)

    def _of(self, name: str):
        return self.getOrDefault(getattr(self, name))


class CycleKMeans(Estimator, _ClusterParams, DefaultParamsReadable, DefaultParamsWritable):
    """K-means of every group at once, as of cluster.kmeans()."""

    def __init__(self, group: str = "cycle", row: str = "id", vector: str = "vector", prediction: str = "clustnum", k: int = 8, starts: int = 3, rounds: int = 100, seed: int = 0):
        super().__init__()
        self._set(group=group, row=row, vector=vector, prediction=prediction, k=k, starts=starts, rounds=rounds, seed=seed)

    def _fit(self, dataset: DataFrame) -> CycleKMeansModel:
        _, centres = cluster.kmeans(dataset, *(self._of(c) for c in ("group", "row", "vector", "k", "starts", "rounds", "seed")))
        return self._copyValues(CycleKMeansModel(centres))


class CycleKMeansModel(Model, _ClusterParams, MLReadable, MLWritable):
    """The centres of each group; transform() adds the nearest one's number, null for rows without a vector or of unknown groups."""

    def __init__(self, centres: DataFrame | None = None):
        super().__init__()
        self.centres = centres

    def _transform(self, dataset: DataFrame) -> DataFrame:
        group, row, vector, prediction = (self._of(c) for c in ("group", "row", "vector", "prediction"))
        near = cluster.assigned(cluster.points_of(dataset, group, row, vector), self.centres)
        near = near.groupBy(F.col("grp").alias("__grp"), F.col("row").alias("__row")).agg(F.min("cluster").alias(prediction))  # repeated rows once
        own = F.coalesce(F.col(group).cast("string"), F.lit("")) == F.col("__grp")
        return dataset.join(near, own & (F.col(row) == F.col("__row")), "left").drop("__grp", "__row")

    def medoids(self, dataset: DataFrame) -> DataFrame:
        """(grp, cluster, medoid, distance), as of cluster.medoids()."""
        return cluster.medoids(cluster.points_of(dataset, *(self._of(c) for c in ("group", "row", "vector"))), self.centres)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: CycleKMeansModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.centres.write.parquet(f"{path}/centres")


class _Reader(MLReader):
    def load(self, path: str) -> CycleKMeansModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CycleKMeansModel(self.sparkSession.read.parquet(f"{path}/centres"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
