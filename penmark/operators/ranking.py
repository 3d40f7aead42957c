"""Exact, skew-safe ranks in a seeded pseudo-random order.

``row_number() OVER (PARTITION BY g ORDER BY x)`` sends a whole group to one
task, and a global ``ORDER BY`` sends everything to one task.  Every order we
need is a seeded hash ``h`` (uniform over 60 bits, ties broken by a unique
column), so a group can be cut into ordered buckets by the top bits of ``h``:
all rows of bucket b precede those of bucket b+1.  Each (group, bucket) is
numbered by a window of its own (a hot group spreads over ``buckets`` tasks),
and a running count over the small (group, bucket) table turns bucket-local
numbers into ranks.  No sampling is involved, so a recomputed task produces
the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

H_BITS = 60


def h60(*parts) -> Column:
    """A 60-bit non-negative integer from md5 of the '|'-joined parts (the SQL
    oracle computes the same value)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    key = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def hash_rank(df: DataFrame, keys: list[str], h: Column, tie: Column, out: str = "rank",
              bucket_bits: int = 10) -> DataFrame:
    """Append ``out`` = 0-based rank within ``keys`` by ``(h, tie)``, where
    ``h`` is a 60-bit hash and ``tie`` is unique within a group.
    ``keys=[]`` ranks all rows."""
    x = df.select("*", h.alias("__h"), tie.alias("__tie"))
    x = x.withColumn("__b", F.shiftright(F.col("__h"), H_BITS - bucket_bits))
    local_w = Window.partitionBy(*keys, "__b").orderBy("__h", "__tie")
    x = x.withColumn("__lr", F.row_number().over(local_w) - 1)
    sizes = x.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    # at most 2**bucket_bits rows per group: the running sum is cheap
    run_w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("__b")
    offsets = sizes.withColumn("__off", F.sum("__c").over(run_w) - F.col("__c")).drop("__c")
    ranked = x.join(offsets, [*keys, "__b"])
    return ranked.withColumn(out, (F.col("__off") + F.col("__lr")).cast("bigint")) \
                 .drop("__h", "__tie", "__b", "__lr", "__off")


def running_offsets(df: DataFrame, weight: str, h: Column, tie: Column, out: str = "offset",
                    bucket_bits: int = 10) -> DataFrame:
    """Append ``out`` = sum of ``weight`` over all rows before a row in the order
    ``(h, tie)``; buckets are summed on their own, as in ``hash_rank``."""
    x = df.select("*", h.alias("__h"), tie.alias("__tie")).withColumn("__b", F.shiftright(F.col("__h"), H_BITS - bucket_bits))
    local = F.sum(weight).over(Window.partitionBy("__b").orderBy("__h", "__tie")) - F.col(weight)
    x = x.withColumn("__local", local)
    # at most 2**bucket_bits rows
    sums = x.groupBy("__b").agg(F.sum(weight).alias("__c"))
    sums = sums.withColumn("__off", F.sum("__c").over(Window.partitionBy().orderBy("__b")) - F.col("__c")).drop("__c")
    return x.join(sums, "__b").withColumn(out, (F.col("__off") + F.col("__local")).cast("bigint")) \
            .drop("__h", "__tie", "__b", "__local", "__off")


def value_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank",
               num_partitions: int | None = None) -> DataFrame:
    """Append ``out`` = 0-based rank of each row within ``keys`` ordered by
    ``value`` (ties in arbitrary but fixed order), without sending a group to
    one task: rows are range partitioned on (keys, value), numbered inside
    each partition, and the numbering is frozen by a checkpoint (range bounds
    come from sampling, so a recomputation could otherwise differ); a small
    table of per-partition group counts turns local numbers into ranks."""
    from penmark.session import cut_lineage
    spark = df.sparkSession
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                              spark.sparkContext.defaultParallelism)
    x = (df.repartitionByRange(n, *keys, value).sortWithinPartitions(*keys, value)
         .withColumn("__pid", F.spark_partition_id())
         .withColumn("__mid", F.monotonically_increasing_id()))
    x = cut_lineage(x)
    counts = x.groupBy("__pid", *keys).agg(F.count(F.lit(1)).alias("__c"), F.min("__mid").alias("__m0"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("__pid")
    offsets = counts.withColumn("__off", F.sum("__c").over(w) - F.col("__c")).drop("__c")
    return (x.join(offsets, ["__pid", *keys])
             .withColumn(out, (F.col("__off") + F.col("__mid") - F.col("__m0")).cast("bigint"))
             .drop("__pid", "__mid", "__m0", "__off"))


def value_ranges(df: DataFrame, keys: list[str], value: str, num_partitions: int | None = None) -> DataFrame:
    """Distinct ``(keys, value)`` with ``first`` and ``n``: the value's rows take the
    0-based ranks ``first .. first + n - 1`` within ``keys``.  Equal values are
    counted before anything is sorted (map-side combine), so a value that most rows
    share is one row here; the distinct values are range partitioned and numbered by
    running counts, and a small table of per-partition totals makes them global."""
    from penmark.session import cut_lineage
    spark = df.sparkSession
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                              spark.sparkContext.defaultParallelism)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    # range bounds come from sampling: frozen, so that a recomputation can't differ
    x = cut_lineage(counted.repartitionByRange(n, *keys, value).withColumn("__pid", F.spark_partition_id()))
    run_w = Window.partitionBy("__pid", *keys).orderBy(value)
    x = x.withColumn("__before", F.sum("n").over(run_w) - F.col("n"))
    totals = x.groupBy("__pid", *keys).agg(F.sum("n").alias("__c"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("__pid")
    offsets = totals.withColumn("__off", F.sum("__c").over(w) - F.col("__c")).drop("__c")
    return (x.join(offsets, ["__pid", *keys])
             .withColumn("first", (F.col("__off") + F.col("__before")).cast("bigint"))
             .drop("__pid", "__before", "__off"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (= ``percentile`` /
    ``quantile_cont``) per group, safe for hot groups and hot values: only the
    distinct values around each requested rank are fetched.  Returns keys +
    ``q0, q1, ...``."""
    if not keys:
        return exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs).drop("__all")
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    from penmark.session import cut_lineage
    r = cut_lineage(value_ranges(v, keys, "__v"))      # read twice below
    sizes = r.groupBy(*keys).agg(F.sum("n").alias("__n"))
    targets = sizes.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"), (F.lit(p) * (F.col("__n") - 1)).alias("h")) for i, p in enumerate(probs)
    ])).alias("t")).select(*keys, "t.qi", "t.h")
    ends = targets.select(*keys, "qi", "h", F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("__r"))
    # each rank lies in the range of exactly one distinct value
    on = [r[k].eqNullSafe(ends[k]) for k in keys]
    hit = (F.col("__r") >= F.col("first")) & (F.col("__r") < F.col("first") + F.col("n"))
    found = ends.join(r, [*on, hit]).select(*[ends[k] for k in keys], "qi", "h", "__r", "__v")
    q = found.groupBy(*keys, "qi", "h").agg(F.min_by("__v", "__r").alias("v_lo"), F.max_by("__v", "__r").alias("v_hi"))
    val = F.col("v_lo") + (F.col("h") - F.floor("h")) * (F.col("v_hi") - F.col("v_lo"))
    wide = q.groupBy(*keys).pivot("qi", list(range(len(probs)))).agg(F.first(val))
    return wide.select(*keys, *[F.col(str(i)).alias(f"q{i}") for i in range(len(probs))])
