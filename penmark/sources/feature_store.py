"""Feature store (D7, J1, J6): features written once, bucketed and sorted by article id.

Pair building looks the same articles up again and again.  Stored in buckets of the
id, the features are neither recomputed nor shuffled for a look-up: only the pair
ends (ids, no vectors) move to the buckets.  The files lie in a shared folder; the
session's catalog only names them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.sources.files import scratch_path


def write(features: DataFrame, id_col: str = "article_id", buckets: int = 64, path: str | None = None, name: str | None = None) -> str:
    """Write ``features`` and return the table's name.  ``buckets`` should follow the table's
    size (some 200 MB each) and be shared by the tables that are joined."""
    spark = features.sparkSession
    name = name or f"features_{uuid.uuid4().hex}"
    # one task per bucket, so that a bucket is one file
    rows = features.repartition(buckets, id_col)
    (rows.write.format("parquet").mode("overwrite").bucketBy(buckets, id_col).sortBy(id_col)
         .option("path", path or scratch_path(spark, name)).saveAsTable(name))
    return name


def lookup(pairs: DataFrame, store: DataFrame, cols: list[str], key: str = "pair_id", id_col: str = "article_id",
           left: str = "id1", right: str = "id2", prefixes=("a1_", "a2_")) -> DataFrame:
    """``cols`` of both ends of every pair from a stored table: the ends are
    shuffled to the buckets, merge-joined there, and folded back per pair."""
    from penmark.operators.pairs import attach_both
    return attach_both(pairs, store.hint("merge"), id_col, cols, key, left, right, prefixes)


def abs_differences(pairs: DataFrame, store: DataFrame, vec_col: str = "features", id_col: str = "article_id") -> DataFrame:
    """|f(id1) - f(id2)| element-wise, from the store."""
    j = lookup(pairs, store, [vec_col], id_col=id_col, prefixes=("__v1_", "__v2_"))
    diff = F.zip_with(f"__v1_{vec_col}", f"__v2_{vec_col}", lambda x, y: F.abs(x - y))
    return j.select(*pairs.columns, diff.alias("diff"))
