"""The wide feature vector by registry.

A vector has one position per feature of several families; its width is known only
when the tags and terms of a corpus have been seen.  The *registry* is the
dictionary of positions (pos, family, name), built from them.  Articles are sparse
rows ``cells: array<struct<pos, value>>``, so no 600-column projection is ever planned:

* assembling costs one shuffle by article over the cells that have a value;
* the fit is one aggregation by position (partial sums map-side, so what is shuffled is
  the width times the number of partitions);
* standardising is map-only: a dense base vector, and the row's cells scattered into it.

A cell that is absent is *missing* (imputed by the mean) in the feature and tag families,
as a tag that an article lacks has no frequency, and zero among the n-gram weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.sources import files

MAX_TAGS = 10_000       # a tagger's inventory; more names in one family are refused
CELLS = "array<struct<pos:int,value:double>>"


@dataclass
class Fixed:
    """Named columns of a frame (article_id, names...)."""
    family: str
    names: list[str]
    df: DataFrame
    zero: bool = False

    def build(self, first: int) -> tuple[list[str], DataFrame]:
        cells = F.array(*[F.struct(F.lit(first + i).alias("pos"), F.col(c).cast("double").alias("value")) for i, c in enumerate(self.names)])
        return self.names, self.df.select("article_id", F.filter(cells, lambda c: c["value"].isNotNull()).alias("cells"))


@dataclass
class Tags:
    """Long frequencies (article_id, tag, freq); the names are the tags seen."""
    family: str
    df: DataFrame
    pattern: str = "{}"
    zero: bool = False

    def build(self, first: int) -> tuple[list[str], DataFrame]:
        seen = self.df.select("tag").where("tag is not null").distinct().limit(MAX_TAGS + 1).collect()
        if len(seen) > MAX_TAGS:
            raise ValueError(f"family {self.family}: more than {MAX_TAGS} different tags")
        tags = sorted((r.tag for r in seen), key=lambda t: t.encode())
        numbers = self.df.sparkSession.createDataFrame([(t, first + i) for i, t in enumerate(tags)], "tag string, pos int")
        cells = self.df.join(numbers, "tag").groupBy("article_id").agg(
            F.collect_list(F.struct("pos", F.col("freq").cast("double").alias("value"))).alias("cells"))
        return [self.pattern.format(t) for t in tags], cells


@dataclass
class Vector:
    """Dense rows (article_id, values) over given names, mostly zeros."""
    family: str
    names: list[str]
    df: DataFrame
    zero: bool = True

    def build(self, first: int) -> tuple[list[str], DataFrame]:
        cells = F.transform("values", lambda v, i: F.struct((i + first).cast("int").alias("pos"), v.alias("value")))
        return self.names, self.df.select("article_id", F.filter(cells, lambda c: c["value"] != 0).alias("cells"))


@dataclass
class Sparse:
    """Rows (article_id, values: struct<at: positions in the names, w: their values>); other positions are zero."""
    family: str
    names: list[str]
    df: DataFrame
    zero: bool = True

    def build(self, first: int) -> tuple[list[str], DataFrame]:
        cells = F.zip_with("values.at", "values.w", lambda a, w: F.struct((a + first).cast("int").alias("pos"), w.alias("value")))
        return self.names, self.df.select("article_id", cells.alias("cells"))


@dataclass
class Registry:
    """(pos, family, name, zero); as many rows as the vector is wide."""
    rows: list[tuple[int, str, str, bool]]
    spark: object

    @property
    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "pos int, family string, name string, zero boolean")

    def save(self, path: str) -> None:
        self.table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> Registry:
        return Registry(sorted(tuple(r) for r in spark.read.parquet(path).select("pos", "family", "name", "zero").collect()), spark)


def assemble(ids: DataFrame, parts: list) -> tuple[Registry, DataFrame]:
    """The registry of the parts, and one sparse row (article_id, cells by position)
    per row of ``ids`` (distinct article_id), written as Parquet: the fit and the transform read it."""
    spark = ids.sparkSession
    registry: list[tuple] = []
    pieces = ids.select("article_id", F.array().cast(CELLS).alias("cells"))
    for part in parts:
        names, cells = part.build(len(registry))
        registry += [(len(registry) + i, part.family, n, part.zero) for i, n in enumerate(names)]
        pieces = pieces.unionByName(cells.select("article_id", F.col("cells").cast(CELLS).alias("cells")))
    rows = pieces.groupBy("article_id").agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))
    path = files.write_parquet(rows, files.scratch_path(spark, "wide"))
    return Registry(registry, spark), spark.read.schema(f"article_id bigint, cells {CELLS}").parquet(path)


@dataclass
class WideStats:
    """Mean and scale of the kept positions; a position that no article has a value for is dropped unless absent means zero."""
    keep: list[int]
    mean: list[float]
    scale: list[float]
    zero: list[bool]


def fit(registry: Registry, rows: DataFrame) -> WideStats:
    n = rows.count()
    seen = {r.pos: r for r in rows.select(F.inline("cells")).groupBy("pos").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")).collect()}
    keep, mean, scale, zeros = [], [], [], []
    for pos, _, _, zero in registry.rows:
        r = seen.get(pos)
        if r is None and not zero:
            continue
        got, m, var = (r.n, r["mean"], r["var"]) if r else (0, 0.0, 0.0)
        # the other n - got cells sit at the mean, or are zeros
        spread = var * got + (m * m * got * (n - got) / n if zero and n else 0.0)
        m = m * got / n if zero and n else m
        sd = math.sqrt(spread / n) if n else 0.0
        keep.append(pos)
        mean.append(m)
        scale.append(sd if sd > 10 * 2.220446049250313e-16 else 1.0)
        zeros.append(zero)
    return WideStats(keep, mean, scale, zeros)


def standardize(rows: DataFrame, stats: WideStats) -> DataFrame:
    """(article_id, cells): every kept position's (value - mean) / scale."""
    keep, mean, scale = np.array(stats.keep, dtype=np.int64), np.array(stats.mean), np.array(stats.scale)
    place = np.full(int(keep.max()) + 1 if len(keep) else 1, -1, dtype=np.int64)
    place[keep] = np.arange(len(keep))
    base = np.where(stats.zero, (0.0 - mean) / scale, 0.0)

    def run(batches):
        for b in batches:
            cells = b.column(1)
            flat = cells.flatten()
            size = np.diff(cells.offsets.to_numpy())
            row = np.repeat(np.arange(len(cells)), size)
            pos, value = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            known = pos < len(place)
            at = np.where(known, place[np.minimum(pos, len(place) - 1)], -1)
            row, at, value = row[at >= 0], at[at >= 0], value[at >= 0]
            dense = np.tile(base, (len(cells), 1))
            dense[row, at] = (value - mean[at]) / scale[at]
            offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * len(keep))
            out = pa.StructArray.from_arrays([pa.array(np.tile(keep, len(cells)), type=pa.int32()), pa.array(dense.ravel())], ["pos", "value"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, out)], ["article_id", "cells"])

    return rows.select("article_id", "cells").mapInArrow(run, f"article_id bigint, cells {CELLS}")


def cells(rows: DataFrame) -> DataFrame:
    """One row (article_id, pos, value) per cell."""
    return rows.select("article_id", F.inline("cells")).select("article_id", F.col("pos").cast("bigint").alias("pos"), "value")


def dense(rows: DataFrame, out: str = "z") -> DataFrame:
    """Standardised rows as (article_id, array of doubles)."""
    return rows.select("article_id", F.transform("cells", lambda c: c["value"]).alias(out))
