"""Sources and sinks.

Everything is a DataFrame reader or writer.  File listings use the
``binaryFile`` source (distributed listing, no driver-side walk); CSV with
embedded newlines needs ``multiLine`` (which makes a file unsplittable), so
CSV input is meant to be converted to Parquet once, via ``to_parquet``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from penmark.functions import text as T
from penmark.session import ensure_checkpoint_dir

# --- FIXED VALUES: article columns and text column candidates ---
ARTICLE_COLUMNS = ["Author", "Source", "NYT", "Genre", "PubDate", "Article Title", "Article Text", "URL"]
REQUIRED_COLUMNS = ["Author", "Source", "NYT", "Article Title", "Article Text"]
TEXT_COLUMN_CANDIDATES = ["Article Text", "article_text", "Text", "text", "Content", "content"]

ARTICLE_CSV_SCHEMA = T_.StructType([T_.StructField(c, T_.StringType(), True) for c in ARTICLE_COLUMNS])


def read_articles_csv(spark: SparkSession, path: str, schema: T_.StructType = ARTICLE_CSV_SCHEMA) -> DataFrame:
    """Header CSV whose text fields may hold newlines and quotes."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("quote", '"').csv(path))


def require_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> None:
    """Raise if any required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def text_column(df: DataFrame, candidates: list[str] = TEXT_COLUMN_CANDIDATES) -> str:
    """S3: the first candidate text column present (no interactive prompt)."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no text column among {candidates}; columns: {df.columns}")


def list_files(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """Recursive listing with content (``binaryFile``), plus the path
    parts the source/genre come from."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", glob).load(root))
    return df.select("path", "modificationTime", "length", "content")


def path_metadata(df: DataFrame, path_col: str = "path", root_depth: int = 0) -> DataFrame:
    """Source and genre folders below the root (parts 1 and 2)."""
    return df.withColumn("source", T.path_part(path_col, root_depth + 1)) \
             .withColumn("genre", T.path_part(path_col, root_depth + 2))


def concat_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str, out: str = "text") -> DataFrame:
    """Document text = its page texts joined in page order.  One group
    is one document's pages."""
    g = pages.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"),
                                                                         F.col(text_col).alias("t")))).alias("__pg"))
    return g.select(doc_col, F.array_join(F.transform("__pg", lambda x: x["t"]), "").alias(out))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a
    machine-local temp dir on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> str:
    """Fixed column order, header, quoted text."""
    (df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True)
       .option("escape", '"').option("quote", '"').csv(path))
    return path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None) -> str:
    """S6 default sink; partitioning by source lets readers prune folders."""
    w = df.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def to_parquet(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    """Convert an (unsplittable, multi-line) article CSV once to Parquet."""
    write_parquet(read_articles_csv(spark, csv_path), parquet_path)
    return spark.read.parquet(parquet_path)


def write_report(df: DataFrame, path: str) -> str:
    """A (section, name, value) report table as JSON lines (written in
    parallel by the executors, not assembled on the driver)."""
    df.write.mode("overwrite").json(path)
    return path
