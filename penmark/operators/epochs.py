"""Elastic-net logistic training in true epochs (M7, M8).

One epoch is one step of accelerated proximal gradient descent, with the weights
carried over from the epoch before: the data are read once per epoch, by one
JVM aggregation that returns the gradient at the extrapolated weights and, from
the same pass, loss and accuracy of every split at the current weights.  Only sums cross
the network: a vector of the feature width per partition and split.

Objective over the training rows: mean log loss + alpha * (l1_ratio * |w|_1 +
(1 - l1_ratio) / 2 * |w|^2); the intercept is not penalised.  The step is
1 / (the trace bound of the curvature), so it needs no tuning and the run
is deterministic up to the order of floating sums.

The weights with the lowest validation loss are kept; training can stop
after ``patience`` epochs without a lower one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-15


def array_sql(xs: list[float]) -> str:
    """A literal array as SQL text: one parser call instead of one call per element."""
    return f"array({', '.join(f'{x!r}D' for x in xs)})" if xs else "cast(array() as array<double>)"


def margin_sql(vec: str, weights: list[float], intercept: float) -> str:
    return f"aggregate(zip_with({vec}, {array_sql(weights)}, (x, w) -> x * w), {intercept!r}D, (a, v) -> a + v)"


@dataclass
class LinearModel:
    """Weights of a logistic model and the epoch they come from."""
    weights: list[float]
    intercept: float
    epoch: int = 0
    history: list[tuple] = field(default_factory=list)     # (epoch, split, loss, accuracy)

    def probability(self, vec: str = "z") -> Column:
        return F.expr(f"1 / (1 + exp(-({margin_sql(vec, self.weights, self.intercept)})))")

    def predict(self, df: DataFrame, vec: str = "z") -> DataFrame:
        """``prob_1`` and ``prediction`` appended."""
        return df.withColumn("prob_1", self.probability(vec)).withColumn("prediction", (F.col("prob_1") > 0.5).cast("int"))

    def history_table(self, spark) -> DataFrame:
        """M8: one row per epoch and split."""
        return spark.createDataFrame(self.history, "epoch int, split string, loss double, accuracy double")


def soft_threshold(x: float, by: float) -> float:
    return math.copysign(max(abs(x) - by, 0.0), x)


def pass_over(rows: DataFrame, current: tuple, ahead: tuple) -> dict:
    """Per split: number of rows, mean loss and accuracy at ``current``; for
    'train' also the mean gradient of the log loss at ``ahead``."""
    width = len(current[0])
    p = F.least(F.greatest(F.expr(f"1 / (1 + exp(-({margin_sql('z', *current)})))"), F.lit(EPS)), F.lit(1 - EPS))
    err = F.expr(f"1 / (1 + exp(-({margin_sql('z', *ahead)})))") - F.col("y")
    x = rows.select("split", "y", "z", p.alias("p"), F.when(F.col("split") == "train", err).otherwise(F.lit(0.0)).alias("err"))
    # the factor enters as an array: a lambda that reads an outer column may evaluate it per element
    scaled = F.zip_with("z", F.array_repeat("err", width), lambda v, e: v * e)
    loss = F.when(F.col("y") == 1, -F.log("p")).otherwise(-F.log(F.lit(1.0) - F.col("p")))
    got = x.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg(((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"),
        F.sum("err").alias("err"), Summarizer.metrics("sum").summary(array_to_vector(scaled)).alias("s")).collect()
    return {r.split: (r.n, r.loss, r.accuracy, [v / r.n for v in r.s["sum"].toArray().tolist()], r.err / r.n) for r in got}


def train(df: DataFrame, vec: str = "z", label: str = "label", split: str = "split", alpha: float = 0.001, l1_ratio: float = 0.15,
          max_epochs: int = 100, early_stopping: bool = False, patience: int = 10) -> LinearModel:
    """Train on the rows of split 'train' and validate on 'val' (where there are no
    such rows, the last epoch's weights are kept).  ``vec`` holds equally long
    arrays of doubles, standardised and without missing cells; rows of other splits are not read.
    The rows are cached for the run: one pass per epoch reads them."""
    rows = df.where(F.col(split).isin("train", "val")).select(
        F.col(split).alias("split"), F.col(label).cast("double").alias("y"), F.col(vec).alias("z")).persist()
    try:
        shape = rows.where("split = 'train'").agg(
            F.max(F.size("z")).alias("width"), F.avg(F.aggregate("z", F.lit(1.0), lambda a, v: a + v * v)).alias("norm")).first()
        if shape.width is None:
            raise ValueError("no training rows")
        width = shape.width
        ridge, lasso = alpha * (1 - l1_ratio), alpha * l1_ratio
        step = 1.0 / (0.25 * shape.norm + ridge)
        w, b = [0.0] * width, 0.0
        ahead, t = (list(w), b), 1.0
        best, history, idle = None, [], 0
        for epoch in range(max_epochs + 1):
            got = pass_over(rows, (w, b), ahead)
            if epoch:
                history += [(epoch, s, got[s][1], got[s][2]) for s in ("train", "val") if s in got]
                loss = got["val"][1] if "val" in got else -epoch
                if best is None or loss < best[0]:
                    best, idle = (loss, epoch, list(w), b), 0
                else:
                    idle += 1
                if early_stopping and idle >= patience:
                    break
            if epoch == max_epochs:
                break
            _, _, _, gradient, gradient_b = got["train"]
            new_w = [soft_threshold(u - step * (g + ridge * u), step * lasso) for u, g in zip(ahead[0], gradient)]
            new_b = ahead[1] - step * gradient_b
            t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
            carry = (t - 1) / t_new
            ahead = [x + carry * (x - o) for x, o in zip(new_w, w)], new_b + carry * (new_b - b)
            w, b, t = new_w, new_b, t_new
    finally:
        rows.unpersist()
    if best is None:
        return LinearModel(w, b)
    return LinearModel(best[2], best[3], best[1], history)
