"""Approximate nearest neighbours (operator 8): multiprobe p-stable hashing.

Vectors are scaled to unit length, where the largest cosine is the smallest
distance.  A table hashes a vector by ``k`` Gaussian projections, each cut
into cells of width ``WIDTH`` at a random offset.  A neighbour of cosine c
projects to a normal distribution around c times the query's projection, so every perturbed bucket has a known
chance of holding it; a query visits a table's buckets from the likeliest on until their
chances add up to ``TABLE_CHANCE``.  ``TABLES`` tables miss independently.

A second visit goes by the query's own results: where its worst kept cosine is below ``TARGET_COSINE``,
the buckets that a neighbour of that cosine asks for are visited too.  A query that still has
fewer rows than there are candidates for (up to the wanted number) is compared with all rows, in parts.

The number of projections follows the number of vectors, so buckets stay near
``BUCKET_ROWS``.  Equal vectors are indexed once, with their smallest ids (as many as a result
can hold); a bucket that is large all the same is split into parts of ``PART_ROWS``.  Each (table, bucket, part)
is a unit of work: vectors and probing queries meet there, distances are exact, and a task merges
each query's best few over all its units before they leave.  The last step merges the tables' candidates and ranks them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.llm.common import map_columns, stored

TOP = 5
TABLES = 4
WIDTH = 1.0
CELLS = 4               # cells 0, 1..CELLS left and right of the offset; the outermost are open
TABLE_CHANCE = 0.6
TARGET_COSINE = 0.42    # neighbours of at least this cosine are found with the stated chance
BUCKET_ROWS = 250
PART_ROWS = 4096
HELD_QUERIES = 100_000  # queries whose best rows a task merges before it reports them
SEED = 12345
CELLS_PER_PROJECTION = math.sqrt(2 * math.pi * math.e)      # effective number of unit cells of a normal distribution


class Hasher:
    def __init__(self, dims: int, k: int, tables: int = TABLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.k, self.tables = k, tables
        self.lines = rng.standard_normal((tables, dims, k))
        self.offsets = rng.uniform(0, WIDTH, (tables, k))
        self.base = 2 * CELLS + 1

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Bucket numbers, one row per vector and one column per table."""
        out = np.empty((len(unit), self.tables), dtype=np.int64)
        for t in range(self.tables):
            cell = np.clip(np.floor((unit @ self.lines[t] + self.offsets[t]) / WIDTH), -CELLS, CELLS).astype(np.int64) + CELLS
            out[:, t] = cell @ (self.base ** np.arange(self.k))
        return out

    def probes(self, unit: np.ndarray, table: int, chance: float = TABLE_CHANCE,
               cosine: float = TARGET_COSINE) -> np.ndarray:
        """Buckets of one table in the order of their chance, for one query, until
        their chances add up.  A heap over the ranks of the cells, by projection: every bucket has one parent (its last raised
        rank lowered), so none comes twice, and only what is visited is made."""
        edges = np.arange(-CELLS, CELLS + 2) * WIDTH
        at = cosine * (unit @ self.lines[table])
        z = (edges[None, :] - self.offsets[table][:, None] - at[:, None]) / math.sqrt(2 * (1 - cosine * cosine))
        z[:, 0], z[:, -1] = -np.inf, np.inf
        p = np.diff(0.5 * (1 + erf(z)), axis=1)
        order = np.argsort(-p, axis=1, kind="stable")
        by_rank = np.take_along_axis(p, order, axis=1).tolist()
        codes = (order * self.base ** np.arange(self.k)[:, None]).tolist()
        heap = [(-math.prod(x[0] for x in by_rank), sum(x[0] for x in codes), (0,) * self.k, 0)]
        found, total = [], 0.0
        while heap and total < chance:
            negative, code, ranks, last = heapq.heappop(heap)
            found.append(code)
            total -= negative
            for i in range(last, self.k):
                r = ranks[i] + 1
                if r < self.base and by_rank[i][r] > 0:
                    heapq.heappush(heap, (negative / by_rank[i][r - 1] * by_rank[i][r], code + codes[i][r] - codes[i][r - 1],
                                          ranks[:i] + (r,) + ranks[i + 1:], i))
        return np.array(found, dtype=np.int64)


erf = np.vectorize(math.erf, otypes=[np.float64])


def usable(vector) -> np.ndarray | None:
    """A vector as doubles, or None if it takes no part."""
    if vector is None or len(vector) == 0 or any(x is None for x in vector):
        return None
    v = np.asarray(vector, dtype=np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def vectors(df: DataFrame, keep: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(raw, ids): usable vectors as little-endian doubles, each once per Arrow
    batch with its ``keep`` smallest ids there (0: all of them)."""
    def run(batches):
        for b in batches:
            ids: dict[bytes, set[int]] = {}
            for i, x in zip(b["vec_id"], b["vector"]):
                v = usable(x)
                if v is not None and i is not None:
                    ids.setdefault(v.astype("<f8").tobytes(), set()).add(i)
            yield {"raw": [*ids], "ids": [sorted(x)[:keep or None] for x in ids.values()]}

    return map_columns(df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector")), run,
                       "raw binary, ids array<bigint>")


def unit_of(raw: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(x, "<f8") for x in raw])
    # scaled first, so that very large and very small components can't overflow
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision, summed in component order whatever else is compared."""
    return float(np.dot(a, b) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b))))


def nearest(df: DataFrame, is_query: Column, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding",
            tables: int = TABLES, chance: float = TABLE_CHANCE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` nearest rows by
    cosine, nearest first, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows with a null id or with fewer or more components than most
    vectors have.  A query never finds rows of its own id; rows that repeat an id count
    once per different vector, by the better score.  Fewer than ``top`` candidates are all returned; an empty table
    gives no rows; other columns are not read (``is_query`` is a condition on ``vec_id``)."""
    keep = top + 1          # one of a result's rows may be the query's own
    lowest = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    # in two steps, so that a very common vector's ids are gathered a few per batch, in parts
    index = vectors(df, keep, id_col, vector_col).groupBy("raw", F.pmod(F.col("ids")[0], F.lit(64)).alias("salt")).agg(lowest) \
        .groupBy("raw").agg(lowest)
    index = stored(index, "ann-index")
    sizes = index.groupBy(F.octet_length("raw").alias("size")).agg(F.count(F.lit(1)).alias("n")) \
                 .orderBy(F.desc("n"), "size").limit(1).collect()
    size, n_rows = (sizes[0]["size"], sizes[0].n) if sizes else (8, 0)
    index = index.where(F.octet_length("raw") == size)
    hasher = Hasher(size // 8, projections(n_rows), tables)

    # queries: each vector probes once, its rows share the answer
    wanted = vectors(df.where(is_query), 0, id_col, vector_col).where(F.octet_length("raw") == size)
    wanted = stored(wanted.select("raw", F.explode("ids").alias("query_id")).distinct(), "ann-queries")
    asked = stored(wanted.groupBy("raw").agg(F.min("query_id").alias("q")), "ann-asked")

    def place(batches):
        for b in batches:
            buckets = hasher.buckets(unit_of(b["raw"]))
            n, t = buckets.shape
            yield {"table": np.repeat(np.arange(t), n), "bucket": buckets.T.ravel(), "raw": b["raw"] * t, "ids": b["ids"] * t}

    def probe(batches):
        for b in batches:
            for q, raw, worst, unit in zip(b["q"], b["raw"], b["worst"], unit_of(b["raw"])):
                for t in range(tables):
                    found = hasher.probes(unit, t, chance)
                    if worst is not None:       # the second visit: what the first one left out
                        found = np.setdiff1d(hasher.probes(unit, t, chance, max(worst, -0.99)), found)
                    yield {"table": np.full(len(found), t), "bucket": found, "q": np.full(len(found), q), "raw": [raw] * len(found)}

    placed = map_columns(index, place, "table int, bucket bigint, raw binary, ids array<bigint>")
    parts = stored(placed.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")), "ann-buckets")
    no_query, no_ids = F.lit(None).cast("bigint").alias("q"), F.lit(None).cast("array<bigint>").alias("ids")
    part = lambda n: F.pmod(F.xxhash64("raw"), n).cast("int").alias("part")
    placed = placed.join(parts, ["table", "bucket"]).select("table", "bucket", part(F.col("parts")), no_query, "raw", "ids")

    def visited(queries):
        """Units of work of some queries (q, raw, worst): the rows of the buckets they probe, and the probes."""
        probes = map_columns(queries.select("q", "raw", "worst"), probe, "table int, bucket bigint, q bigint, raw binary")
        probes = probes.join(parts, ["table", "bucket"]).select(
            "table", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "q", "raw", no_ids)
        return placed.unionByName(probes)

    def everything(queries):
        """The same for queries that are compared with all rows."""
        n = max(1, -(-n_rows // PART_ROWS))
        all_rows = index.select(F.lit(-1).alias("table"), F.lit(0).cast("bigint").alias("bucket"), part(F.lit(n)), no_query, "raw", "ids")
        return all_rows.unionByName(queries.select(F.lit(-1).alias("table"), F.lit(0).cast("bigint").alias("bucket"),
                                                   F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), "q", "raw", no_ids))

    key = ["table", "bucket", "part"]

    def compare(batches):
        at, raw, ids, unit = None, [], [], None
        asking: list[tuple[int, bytes]] = []
        best: dict[int, list[tuple[float, int]]] = {}       # per query, over all buckets of this task

        def answer():
            for (q, own), row in zip(asking, unit_of([r for _, r in asking]) @ unit.T if asking and raw else ()):
                n = len(row)
                least = np.partition(row, n - keep)[n - keep] if n > keep else -2.0
                own = np.frombuffer(own, "<f8")
                found = sorted((-cosine(own, np.frombuffer(raw[j], "<f8")), ids[j]) for j in np.flatnonzero(row >= least - 1e-9))
                best[q] = merge(best.get(q, []), [(s, m) for s, members in found[:keep] for m in members], keep)
            asking.clear()

        def report():
            out = {"q": [q for q, x in best.items() for _ in x], "vec_id": [m for x in best.values() for _, m in x],
                   "score": [-s for x in best.values() for s, _ in x]}
            best.clear()
            return out

        for b in batches:
            for table, bucket, part, q, r, i in zip(*(b[c] for c in (*key, "q", "raw", "ids"))):
                if (table, bucket, part) != at:
                    answer()
                    at, raw, ids, unit = (table, bucket, part), [], [], None
                    if len(best) > HELD_QUERIES:
                        yield report()
                if q is None:
                    raw.append(r)
                    ids.append(i)
                    continue
                if unit is None:
                    unit = unit_of(raw) if raw else np.empty((0, size // 8))
                asking.append((q, r))
                if len(asking) == 256:
                    answer()
        answer()
        if best:
            yield report()

    order = [F.desc("score"), F.asc("vec_id")]

    def search(work, before=None):
        work = work.repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("q"))
        near = map_columns(work, compare, "q bigint, vec_id bigint, score double")
        near = near if before is None else near.unionByName(before)
        near = near.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("n") <= keep).drop("n")
        return stored(near, "ann-near")

    near = search(visited(asked.withColumn("worst", F.lit(None).cast("double"))))
    # at most ``keep`` rows a query
    held = near.groupBy("q").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))
    far = stored(asked.join(held.where(F.col("worst") < TARGET_COSINE), "q").select("q", "raw", "worst"), "ann-far")
    if not far.isEmpty():
        near = search(visited(far), near)
    few = near.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    n_ids = index.select(F.explode("ids").alias("id")).distinct().limit(keep).count()
    short = stored(asked.join(few, "q", "left").where(F.coalesce("n", F.lit(0)) < n_ids).select("q", "raw"), "ann-short")
    if not short.isEmpty():
        near = search(everything(short), near)
    out = wanted.join(asked, "raw").select("query_id", "q").join(near, "q").where("vec_id <> query_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("query_id", "rank", "vec_id", "score")


def merge(a: list[tuple[float, int]], b: list[tuple[float, int]], keep: int) -> list[tuple[float, int]]:
    """The best ``keep`` of two lists of (-score, id), each id once."""
    out: dict[int, float] = {}
    for s, m in sorted(a + b):
        if m not in out:
            out[m] = s
            if len(out) == keep:
                break
    return [(s, m) for m, s in out.items()]


def projections(n_rows: int) -> int:
    """Projections of a table, so that a bucket holds about ``BUCKET_ROWS`` vectors."""
    return max(1, round(math.log(max(n_rows / BUCKET_ROWS, 1)) / math.log(CELLS_PER_PROJECTION)))
