"""Tables that several queries read, written once per application.

Annotated sentences, narrow feature tables and the fitted pair model are dear to make
and small next to the texts.  They are written as Parquet (the model in Spark ML's
format) into the shared folder when a query first asks for them, and read from there
afterwards, as a job would read what an earlier job left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from penmark.sources import files

_paths: dict[tuple[str, str, str], str] = {}


def path_of(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], object]) -> str:
    """The folder of ``name``; ``write(path)`` makes it at first."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _paths:
        path = files.scratch_path(spark, name)
        write(path)
        _paths[key] = path
    return _paths[key]


def stored_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return spark.read.parquet(path_of(spark, sf_dir, name, lambda path: files.write_parquet(build(), path, compression="zstd")))
