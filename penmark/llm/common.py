"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from penmark.session import ensure_checkpoint_dir

# an Arrow batch is held by the JVM and, twice, by its worker: 10,000 rows of long texts (the default) are too many
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

# --- FIXED VALUES: byte map of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased ---
# (digits, a-z and every byte of a non-ASCII character are word bytes; the rest separate words)
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8 bytes; null has none."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage, survives lost executors and lets later readers prune."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Free memory that Arrow and the C library hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):     # glibc only
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of at most about ``BATCH_BYTES``, however long the rows are; a
    worker serves many tasks, so what the batches took is given back when a task ends."""
    if df.sparkSession.conf.get(BATCH_CONF, None) != str(BATCH_BYTES):
        df.sparkSession.conf.set(BATCH_CONF, str(BATCH_BYTES))

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with plain Python columns: ``fn`` gets dicts of lists
    (numpy arrays for id columns are the callee's business) and yields dicts
    of lists in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        def columns():
            for b in batches:
                if b.num_rows:
                    yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        for out in fn(columns()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return map_batches(df, run, schema)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function over a uint64 array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, with a bounded cache (a full cache is emptied;
    values never depend on it)."""

    def __init__(self, limit: int = 400_000):
        self.cache: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash
        if len(self.cache) > self.limit:
            self.cache.clear()
        cache = self.cache
        missing = set(words).difference(cache)
        for w in missing:
            cache[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a word-hash array; a
    text of fewer (but some) words has one shingle of all its words."""
    n = len(h)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    k = min(k, n)
    with np.errstate(over="ignore"):
        acc = splitmix(h[:n - k + 1] + np.uint64(k))
        for i in range(1, k):
            acc = splitmix(acc * np.uint64(0x100000001B3) + h[i:n - k + 1 + i])
    return np.unique(acc)
