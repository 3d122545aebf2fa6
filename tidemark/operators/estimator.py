"""The detector as an estimator and a model of Spark ML, which are saved and loaded with all that scoring needs.

A model's folder holds metadata, parameters (with thresholds and calibration), reference (the cells of its vectors) and
energies (those of its vectors). So a loaded model scores without the table it was fitted on: neighbours come from the
cells, shares of energies from their table. Nothing that grows with the reference goes through the driver."""

from __future__ import annotations

from dataclasses import replace

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import materialize

from . import cells
from . import detector as D

#: Digits of energies, so that a row counts itself in the reference's whatever batch it came in.
DIGITS = 9


class _Columns(Params):
    idCol = Param(Params._dummy(), "idCol", "column of unique integer ids", TypeConverters.toString)
    inputCol = Param(Params._dummy(), "inputCol", "column of vectors, arrays of numbers", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of the score, a struct", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(idCol="id", inputCol="embedding", outputCol="ood")

    def _rows(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(F.col(self.getOrDefault(self.idCol)).cast("long").alias("id"), F.col(self.getOrDefault(self.inputCol)).alias("embedding"))


def _energies(det: D.Detector, rows: DataFrame) -> DataFrame:
    return D.energies(det, rows).withColumn("energy", F.round("energy", DIGITS))


class OODDetector(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the mixture, the thresholds and, with rows whose label is 1, the calibration.

    labelCol, where set, tells the reference (0) from known outliers (1); rows of other labels are left out. Vectors
    that are null, empty or hold nulls aren't fitted on."""

    labelCol = Param(Params._dummy(), "labelCol", "column of 0 (reference) and 1 (outlier)", TypeConverters.toString)
    shrinkage = Param(Params._dummy(), "shrinkage", "weight of the spherical covariance, 0 to 1", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "number of components", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "steps at most", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "least change of the log likelihood", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the first means", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, idCol="id", inputCol="embedding", outputCol="ood", labelCol=None, shrinkage=0.60, components=1, maxIter=100, tol=1e-4, seed=42):
        super().__init__()
        self._setDefault(shrinkage=0.60, components=1, maxIter=100, tol=1e-4, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> OODModel:
        label = self.getOrDefault(self.labelCol) if self.isSet(self.labelCol) else None
        of = lambda y: self._rows(dataset.filter(F.col(label) == y) if label else dataset)
        ref = materialize(of(0))
        value = {p: self.getOrDefault(p) for p in ("shrinkage", "components", "maxIter", "tol", "seed")}
        det = D.mixture(ref, value["shrinkage"], value["components"], value["maxIter"], value["tol"], seed=value["seed"])
        index = cells.build(ref)
        known = materialize(_energies(det, ref).filter("energy is not null").select("energy"))
        others = cells.nearest_in(ref.withColumnRenamed("id", "query_id"), index, 2).filter("rank = 1").select("distance")
        others = materialize(others)
        det.thresholds = D._quantiles(known, "energy", "energy") | D._quantiles(others, "distance", "knn")
        det.knn_ref_mean = others.agg(F.avg("distance")).first()[0]
        if label:
            outliers = materialize(_energies(det, of(1)).filter("energy is not null").select("energy"))
            if outliers.limit(1).count():
                D.calibrate(det, known, outliers)
        return self._copyValues(OODModel(det, index, known).setParent(self))


class OODModel(_Columns, Model, MLReadable, MLWritable):
    """Adds outputCol, the struct of detector.score's columns, to rows of unique ids; null for rows without a vector.
    asQuestions takes the thresholds of questions (with_questions) instead of the chunks'."""

    asQuestions = Param(Params._dummy(), "asQuestions", "whether rows are questions", TypeConverters.toBoolean)

    def __init__(self, detector: D.Detector, index: cells.CellIndex, energies: DataFrame):
        super().__init__()
        self._setDefault(asQuestions=False)
        self.detector, self.index, self.energies = detector, index, energies

    def setParent(self, parent: Estimator) -> OODModel:
        self.parent = parent
        return self

    def setAsQuestions(self, value: bool) -> OODModel:
        return self._set(asQuestions=value)

    def with_questions(self, questions: DataFrame) -> OODModel:
        """A model whose thresholds for questions are the quantiles of these rows' measures."""
        rows = materialize(self._rows(questions))
        found = D._quantiles(_energies(self.detector, rows), "energy", "query_energy") | D._quantiles(self._distances(rows), "knn_distance", "query_knn")
        out = self.copy()
        out.detector = replace(self.detector, thresholds=self.detector.thresholds | found)
        return out

    def _distances(self, rows: DataFrame) -> DataFrame:
        near = cells.nearest_in(rows.withColumnRenamed("id", "query_id"), self.index, 1)
        return near.select(F.col("query_id").alias("id"), F.col("distance").alias("knn_distance"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, out = self.getOrDefault(self.idCol), self.getOrDefault(self.outputCol)
        if out in dataset.columns:
            raise ValueError(f"column {out} exists already")
        rows = self._rows(dataset)
        # read by the energies' histogram and by the join
        e = materialize(_energies(self.detector, rows).filter("energy is not null"))
        s = D.scored(self.detector, e, self._distances(rows), self.energies, self.getOrDefault(self.asQuestions))
        s = s.select(F.col("id").alias("_scored"), F.struct(*[c for c in s.columns if c != "id"]).alias(out))
        return dataset.join(s, F.col(key).cast("long") == F.col("_scored"), "left").drop("_scored")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: OODModel):
        super().__init__()
        self.model = model

    def save(self, path: str) -> None:
        if self.shouldOverwrite and self.model.index.path.startswith(path.rstrip("/") + "/"):
            raise ValueError("a loaded model can't overwrite the folder that it reads")
        super().save(path)

    def saveImpl(self, path: str) -> None:
        spark, m = self.sparkSession, self.model
        DefaultParamsWriter.saveMetadata(m, path, spark)
        D.save(spark, m.detector, f"{path}/parameters")
        for name in ("cells", "members"):
            spark.read.parquet(f"{m.index.path}/{name}").write.parquet(f"{path}/reference/{name}")
        m.energies.write.parquet(f"{path}/energies")


class _Reader(MLReader):
    def load(self, path: str) -> OODModel:
        spark, path = self.sparkSession, path.rstrip("/")
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        m = OODModel(D.load(spark, f"{path}/parameters"), cells.load(spark, f"{path}/reference"), spark.read.parquet(f"{path}/energies"))
        m._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(m, metadata)
        return m
