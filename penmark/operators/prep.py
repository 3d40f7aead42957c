"""Model preparation (M1-M6, K3, U1): imputation, scaling, encoding, splits.

Vectors are ``ARRAY<DOUBLE>`` columns.  Fitting a per-position statistic is
one aggregation over ``posexplode`` (partial aggregation map-side); the fitted
table has one row per vector position -- bounded by the vector width, so it
is collected and applied as literal arrays inside the projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions.lexicons import META_COLUMNS
from penmark.operators import selection
from penmark.operators.ranking import h60, value_rank


@dataclass
class VectorStats:
    """Per-position fit: positions kept (not entirely missing), their mean
    and population standard deviation after mean imputation."""
    keep: list[int]
    mean: list[float]
    scale: list[float]

    @property
    def width(self) -> int:
        return len(self.keep)

    def save(self, spark, path: str) -> None:
        """One row per kept position (bounded by the vector width)."""
        rows = list(zip(self.keep, self.mean, self.scale))
        spark.createDataFrame(rows, "pos int, mean double, scale double").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> VectorStats:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.pos)
        return VectorStats([r.pos for r in rows], [r["mean"] for r in rows], [r["scale"] for r in rows])


def _clean(v: Column) -> Column:
    return F.when(F.isnan(v), F.lit(None)).otherwise(v)


def coerce_number(v: Column) -> Column:
    """Text -> DOUBLE; unparseable text and NaN -> NULL."""
    return _clean(v.try_cast("double"))


WIDEST = 128        # positions that are fitted as columns of one aggregate; wider vectors become one row per cell


def moments(df: DataFrame, vec_col: str, width: int | None = None) -> DataFrame:
    """(pos, n, nn, mean, var): cells, present cells, their mean and population
    variance.  With a small ``width`` (vectors of exactly so many cells) this is one
    aggregate over the rows as they are."""
    if width is None or width > WIDEST:
        long = df.select(F.posexplode_outer(vec_col).alias("pos", "v")).where(F.col("pos").isNotNull()).select("pos", _clean(F.col("v")).alias("v"))
        return long.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("nn"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    cell = lambda i: f"nullif({vec_col}[{i}], double('NaN'))"
    wide = df.selectExpr("count(1) as n", *[f"struct({i} as pos, count({cell(i)}) as nn, avg({cell(i)}) as mean, var_pop({cell(i)}) as var) as c{i}"
                                            for i in range(width)])
    return wide.select("n", F.inline(F.array(*[f"c{i}" for i in range(width)]))).select("pos", "n", "nn", "mean", "var")


def fit_vector_stats(df: DataFrame, vec_col: str, width: int | None = None) -> VectorStats:
    """M1 + M2 fit.  The imputer drops all-missing positions; the scaler's
    std is that of the imputed column (missing cells sit at the mean), with
    0 replaced by 1."""
    keep, mean, scale = [], [], []
    for r in sorted(moments(df, vec_col, width).where("nn > 0").collect(), key=lambda r: r["pos"]):
        sd = math.sqrt(r["var"] * r["nn"] / r["n"])
        keep.append(int(r["pos"]))
        mean.append(float(r["mean"]))
        scale.append(sd if sd > 10 * 2.220446049250313e-16 else 1.0)
    return VectorStats(keep, mean, scale)


def _lit_array(xs, typ="double") -> Column:
    return F.array(*[F.lit(x).cast(typ) for x in xs]) if xs else F.array().cast(f"array<{typ}>")


def select_positions(vec: Column, keep: list[int]) -> Column:
    """The kept positions of a vector, in order (K3 by position).  The lambda
    sees only its own variables and literals, never an outer column."""
    return F.filter(vec, lambda x, i: i.isin(keep))


def impute(df: DataFrame, vec_col: str, stats: VectorStats, out: str | None = None) -> DataFrame:
    """M1 transform: keep fitted positions, missing -> fitted mean."""
    sel = select_positions(F.col(vec_col), stats.keep)
    filled = F.zip_with(sel, _lit_array(stats.mean), lambda v, m: F.coalesce(_clean(v), m))
    return df.withColumn(out or vec_col, filled)


def standardize(df: DataFrame, vec_col: str, stats: VectorStats, out: str | None = None) -> DataFrame:
    """M1 then M2 transform: (imputed - mean) / scale."""
    x = impute(df, vec_col, stats, "__imp")
    centred = F.zip_with(F.col("__imp"), _lit_array(stats.mean), lambda v, m: v - m)
    scaled = F.zip_with(centred, _lit_array(stats.scale), lambda c, s: c / s)
    return x.withColumn(out or vec_col, scaled).drop("__imp")


def feature_columns(df: DataFrame, keys: list[str] | None = None) -> list[str]:
    """The columns that are neither keys nor metadata, in order."""
    return [c for c in df.columns if c not in META_COLUMNS and c not in (keys or [])]


def align_by_name(df: DataFrame, expected: list[str], fill: float = 0.0) -> DataFrame:
    """K3: select the expected feature columns by name; a missing column is
    ``fill`` (0 after scaling = the training mean), extra columns are
    dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).cast("double").alias(c) for c in expected])


def union_features(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column absent from a frame is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def label_encode(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """M3: class -> index in alphabetical order of the classes.  The classes are
    ranked as a distributed table and joined back, so their number is not bounded by the driver."""
    classes = value_rank(df.select(col).where(F.col(col).isNotNull()).distinct(), [], col, out="__index")
    return df.join(classes.withColumnRenamed("__index", out), col, "left")


def hash_split(df: DataFrame, id_col: str, train_pct: int = 80, seed: int = 42, out: str = "split") -> DataFrame:
    """M4: stable split by a seeded hash bucket of the id (unchanged by
    repartitioning, unlike ``randomSplit``)."""
    b = F.pmod(h60(seed, "bucket", F.col(id_col)), F.lit(100))
    return df.withColumn(out, F.when(b < train_pct, F.lit("train")).otherwise(F.lit("test")))


def split_data(df: DataFrame, id_col: str, test_size: float = 0.2, val_size: float = 0.1,
               seed: int = 42, out: str = "split") -> DataFrame:
    """M5: seeded shuffle, then train / val / test by position with
    ``int()``-truncated sizes (the remainder goes to train).  Positions are never
    computed: the thresholds between the parts are selected."""
    n = df.count()
    n_test, n_val = math.floor(n * test_size), math.floor(n * val_size)
    return selection.split_by_quotas(df, h60(seed, "split", F.col(id_col)), F.col(id_col),
                                     [("train", n - n_test - n_val), ("val", n_val)], "test", out)


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.3,
                     val_share: float = 0.5, seed: int = 42, out: str = "split") -> DataFrame:
    """M6: per label, seeded shuffle; the first ``ceil(test_size * n_label)``
    rows are held out and split again ``val_share`` : rest into val / test."""
    def quotas(n: int) -> list[tuple[str, int]]:
        held = math.ceil(n * test_size)
        n_val = math.floor(held * val_share)
        return [("val", n_val), ("test", held - n_val)]

    return selection.split_groups(df, label_col, h60(seed, "strat", F.col(id_col)), F.col(id_col), quotas, "train", out)
