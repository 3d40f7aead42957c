"""One fitted bundle (S9, M7, M11): registry, statistics, vocabulary and model together.

``PairClassifier`` is an estimator over labelled pair vectors; its model holds
everything that scoring needs, under one version, and is saved and loaded by Spark
ML persistence: metadata as JSON, the rest as small Parquet tables.  A session that has
never seen the training data loads the folder and scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam, HasElasticNetParam
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from penmark.operators import epochs, prep
from penmark.operators.ngrams import TfidfModel

VERSION = 1


class _PairParams(HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam, HasElasticNetParam):
    splitCol = Param(Params._dummy(), "splitCol", "column that says train or val", typeConverter=TypeConverters.toString)
    earlyStopping = Param(Params._dummy(), "earlyStopping", "stop when the validation loss has not improved", typeConverter=TypeConverters.toBoolean)
    patience = Param(Params._dummy(), "patience", "epochs without improvement before stopping", typeConverter=TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(featuresCol="diff", labelCol="label", maxIter=100, regParam=0.001, elasticNetParam=0.15, splitCol="split",
                         earlyStopping=False, patience=10)


class PairClassifier(Estimator, _PairParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits imputer, scaler and the epochs' best weights on arrays of ``names``
    features.  ``tfidf`` is carried along for vectors that hold n-gram weights."""

    def __init__(self, names: list[str] | None = None, tfidf: TfidfModel | None = None, **params):
        super().__init__()
        self.names, self.tfidf = names or [], tfidf
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> PairClassifierModel:
        vec, split = self.getOrDefault("featuresCol"), self.getOrDefault("splitCol")
        stats = prep.fit_vector_stats(dataset.where(dataset[split] == "train"), vec, len(self.names) or None)
        linear = epochs.train(prep.standardize(dataset, vec, stats, "__z"), "__z", self.getOrDefault("labelCol"), split,
                              self.getOrDefault("regParam"), self.getOrDefault("elasticNetParam"), self.getOrDefault("maxIter"),
                              self.getOrDefault("earlyStopping"), self.getOrDefault("patience"))
        return self._copyValues(PairClassifierModel(Fitted(self.names, stats, linear, self.tfidf)))


@dataclass
class Fitted:
    names: list[str]
    stats: prep.VectorStats
    linear: epochs.LinearModel
    tfidf: TfidfModel | None = None


class PairClassifierModel(Model, _PairParams, MLWritable, MLReadable):
    """Appends ``prob_1`` and ``prediction`` to rows with the feature array."""

    def __init__(self, fitted: Fitted | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        z = prep.standardize(dataset, self.getOrDefault("featuresCol"), self.fitted.stats, "__z")
        return self.fitted.linear.predict(z, "__z").drop("__z")

    def history(self, spark: SparkSession) -> DataFrame:
        return self.fitted.linear.history_table(spark)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: PairClassifierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        f = self.model.fitted
        DefaultParamsWriter.saveMetadata(self.model, path, spark.sparkContext, extraMetadata={
            "bundleVersion": VERSION, "intercept": f.linear.intercept, "epoch": f.linear.epoch, "tfidf": f.tfidf is not None})

        def put(rows, schema, name):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")

        put(list(enumerate(f.names)), "pos int, name string", "registry")
        put(list(zip(f.stats.keep, f.stats.mean, f.stats.scale, f.linear.weights)), "pos int, mean double, scale double, weight double", "vector")
        put(f.linear.history, "epoch int, split string, loss double, accuracy double", "history")
        if f.tfidf is not None:
            f.tfidf.save(spark, f"{path}/vocabulary")


class _Reader(MLReader):
    def load(self, path: str) -> PairClassifierModel:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark.sparkContext, PairClassifierModel.__module__ + ".PairClassifierModel")
        if meta["bundleVersion"] != VERSION:
            raise ValueError(f"{path}: bundle of version {meta['bundleVersion']}, this library reads {VERSION}")
        read = lambda name: spark.read.parquet(f"{path}/{name}").collect()
        names = [r.name for r in sorted(read("registry"))]
        vector = sorted(read("vector"))
        history = sorted((tuple(r) for r in read("history")), key=lambda r: (r[0], r[1] != "train"))
        linear = epochs.LinearModel([r.weight for r in vector], meta["intercept"], meta["epoch"], history)
        stats = prep.VectorStats([r.pos for r in vector], [r["mean"] for r in vector], [r["scale"] for r in vector])
        model = PairClassifierModel(Fitted(names, stats, linear, TfidfModel.load(spark, f"{path}/vocabulary") if meta["tfidf"] else None))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
