"""Exact splits by selection (M5, M6): no row is ranked, sorted or shuffled.

A split by quota takes the rows whose (hash, id) is among the smallest so many.  The
quota's threshold is found by refining a histogram of the 60-bit hash: a pass counts the
rows by the next ``BITS`` bits inside the one bucket that holds the threshold, so a few counting
passes (partial counts map-side, at most 2^BITS rows per group shuffled) reach a bucket
small enough to read its hashes in order.  Splitting is then a comparison per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.operators.ranking import H_BITS

BITS = 12
SMALL = 4096        # rows of a bucket that are read in order

Threshold = tuple[int, object]      # (hash, tie): rows up to and including it are taken


def threshold(rows: DataFrame, h: str, tie: str, quota: int) -> Threshold | None:
    """The (hash, tie) of the ``quota``-th smallest row (from 1), None if the quota
    is 0; ``tie`` is unique."""
    if quota <= 0:
        return None
    low, bits, before = 0, H_BITS, 0        # the bucket [low, low + 2^bits) and the rows before it
    inside = rows
    while True:
        step = max(0, bits - BITS)
        counts = {r.b: r.n for r in inside.groupBy(F.expr(f"shiftright({h}, {step})").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in sorted(counts):
            if before + counts[b] >= quota:
                break
            before += counts[b]
        else:
            raise ValueError(f"quota {quota} of {before} rows")
        low, bits = b << step, step
        inside = rows.where((F.col(h) >= low) & (F.col(h) < low + (1 << bits)))
        if counts[b] <= SMALL or bits == 0:
            break
    if counts[b] <= SMALL:
        got = sorted((tuple(r) for r in inside.select(h, tie).collect()))
        return got[quota - before - 1]
    # many rows of one hash value: the tie decides
    best = inside.select(tie).orderBy(tie).limit(quota - before).agg(F.max(tie).alias("t")).first()
    return low, best.t


def within(h: Column, tie: Column, at: Threshold | None) -> Column:
    """True for the rows up to the threshold."""
    if at is None:
        return F.lit(False)
    return (h < at[0]) | ((h == at[0]) & (tie <= F.lit(at[1])))


def split_by_quotas(df: DataFrame, h: Column, tie: Column, quotas: list[tuple[str, int]], rest: str, out: str = "split") -> DataFrame:
    """``out``: the first so many rows in the order (h, tie) get the first name, the next the second, and so on; the others ``rest``."""
    keyed = df.select(h.alias("__h"), tie.alias("__t"))
    # counted several times: two small columns, kept on the executors
    keyed = keyed.persist()
    try:
        taken, names = 0, []
        for name, quota in quotas:
            taken += quota
            names.append((name, threshold(keyed, "__h", "__t", taken)))
    finally:
        keyed.unpersist()
    split = F.lit(rest)
    for name, at in reversed(names):
        split = F.when(within(h, tie, at), F.lit(name)).otherwise(split)
    return df.withColumn(out, split)


def split_groups(df: DataFrame, group: str, h: Column, tie: Column, quotas, rest: str, out: str = "split") -> DataFrame:
    """``split_by_quotas`` within each value of ``group``; ``quotas(n)`` gives a group's
    quotas from its size.  For a few groups, such as the classes of a label: each is
    selected on its own.  Rows without a group get ``rest``."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(group).collect()
    keyed = df.select(F.col(group).alias("__g"), h.alias("__h"), tie.alias("__t")).persist()
    try:
        split = F.lit(rest)
        for r in sizes:
            taken, names = 0, []
            for name, quota in quotas(r["n"]):
                taken += quota
                names.append((name, threshold(keyed.where(F.col("__g") == F.lit(r[group])), "__h", "__t", taken)))
            own = F.lit(rest)
            for name, at in reversed(names):
                own = F.when(within(h, tie, at), F.lit(name)).otherwise(own)
            split = F.when(F.col(group) == F.lit(r[group]), own).otherwise(split)
    finally:
        keyed.unpersist()
    return df.withColumn(out, split)
