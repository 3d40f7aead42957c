"""Mergeable fit state (N3, M1, M2): new batches without reading old texts.

A fit that keeps its sufficient statistics as tables can take in a batch by merging two
small states: terms as (term, cf, df) with the number of documents, vector positions as
(pos, n, nn, mean, m2).  fit(a) merged with fit(b) is fit(a and b): counts add, and means
and squared deviations combine by the parallel-variance rule.  One aggregation by key
merges any number of states; texts and vectors of earlier batches are not needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.operators import ngrams, prep

VERSION = 1


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass
class TermState:
    """(term, cf, df) of every term, and the number of documents."""
    terms: DataFrame
    n_docs: int

    @staticmethod
    def of(docs: DataFrame, text_col: str = "text") -> TermState:
        return TermState(ngrams.term_stats(docs, text_col), docs.count())

    def merge(self, *others: TermState) -> TermState:
        terms = _union([self.terms, *(o.terms for o in others)]).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
        return TermState(terms, self.n_docs + sum(o.n_docs for o in others))

    def model(self, max_features: int = 500) -> ngrams.TfidfModel:
        best = ngrams.vocabulary(self.terms, max_features).collect()     # max_features rows
        return ngrams.model_of([(r.term, r.cf, r.df) for r in best], self.n_docs)

    def save(self, path: str) -> TermState:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark = self.terms.sparkSession
        spark.createDataFrame([(VERSION, self.n_docs)], "version int, n_docs bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")
        return TermState.load(spark, path)

    @staticmethod
    def load(spark, path: str) -> TermState:
        size = spark.read.parquet(f"{path}/size").first()
        if size.version != VERSION:
            raise ValueError(f"{path}: state of version {size.version}, this library reads {VERSION}")
        return TermState(spark.read.parquet(f"{path}/terms"), size.n_docs)


@dataclass
class MomentState:
    """(pos, n, nn, mean, m2): cells, present cells, their mean and their sum of squared deviations."""
    moments: DataFrame

    @staticmethod
    def of(df: DataFrame, vec_col: str, width: int | None = None) -> MomentState:
        m2 = F.coalesce(F.col("var") * F.col("nn"), F.lit(0.0))
        return MomentState(prep.moments(df, vec_col, width).select("pos", "n", "nn", F.coalesce("mean", F.lit(0.0)).alias("mean"), m2.alias("m2")))

    def merge(self, *others: MomentState) -> MomentState:
        parts = _union([self.moments, *(o.moments for o in others)])
        nn = F.sum("nn")
        mean = F.sum(F.col("nn") * F.col("mean")) / F.greatest(nn, F.lit(1))
        whole = parts.groupBy("pos").agg(F.sum("n").alias("n"), nn.alias("nn"), mean.alias("mean"), F.sum("m2").alias("within"),
                                         F.collect_list(F.struct("nn", "mean")).alias("parts"))     # one entry per state merged
        apart = F.aggregate(F.transform("parts", lambda x: x["nn"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean"))),
                            F.lit(0.0), lambda a, x: a + x)
        return MomentState(whole.select("pos", "n", "nn", "mean", (F.col("within") + apart).alias("m2")))

    def stats(self) -> prep.VectorStats:
        """The imputer's and scaler's statistics; at most the vector's width of rows."""
        keep, mean, scale = [], [], []
        for r in sorted(self.moments.where("nn > 0").collect(), key=lambda r: r.pos):
            sd = math.sqrt(r.m2 / r.n)      # missing cells sit at the mean
            keep.append(r.pos)
            mean.append(r["mean"])
            scale.append(sd if sd > 10 * 2.220446049250313e-16 else 1.0)
        return prep.VectorStats(keep, mean, scale)

    def save(self, path: str) -> MomentState:
        self.moments.withColumn("version", F.lit(VERSION)).coalesce(1).write.mode("overwrite").parquet(path)
        return MomentState.load(self.moments.sparkSession, path)

    @staticmethod
    def load(spark, path: str) -> MomentState:
        table = spark.read.parquet(path)
        wrong = table.where(F.col("version") != VERSION).first()
        if wrong:
            raise ValueError(f"{path}: state of version {wrong.version}, this library reads {VERSION}")
        return MomentState(table.drop("version"))
