"""Article pairs (A-series, J3-J6).

No pair set is ever enumerated: every pair is a *draw*.  A draw picks ranks
(with a seeded md5 hash, or by a permuted ordinal) and finds the members through equi-joins on
``(group, rank)``; ranks come from ``ranking.hash_rank``, which is exact and
skew-safe.  The number of rows produced is the number of draws asked for.

* same-group pairs of the whole table (A1): n different pairs, or a stated share of all.
* same-group pairs per group (A4): for each group of m >= 2 members,
  ``min(50, m)`` draws of two distinct members.
* cross-group pairs (A2, A5): n draws of two distinct groups, uniform, and one
  member of each, uniform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.operators.ranking import h60, hash_rank, running_offsets


def ranked_members(df: DataFrame, group: str, id_col: str, seed: int) -> DataFrame:
    """(group, id, rank) with ranks in a seeded pseudo-random order.  Read by
    several joins, so it is materialised once (ids only, no text)."""
    from penmark.session import cut_lineage
    m = df.select(group, id_col).where(F.col(group).isNotNull())
    return cut_lineage(hash_rank(m, [group], h60(seed, F.col(id_col)), F.col(id_col), out="rank"))


def _two_distinct(h1: Column, h2: Column, m: Column) -> tuple[Column, Column]:
    """Two distinct values in [0, m) from two hashes (m >= 2)."""
    r1 = F.pmod(h1, m)
    r2 = F.pmod(h2, m - 1)
    return r1, F.when(r2 >= r1, r2 + 1).otherwise(r2)


def same_group_pairs(df: DataFrame, group: str, id_col: str, draws_per_group: int = 50,
                     seed: int = 42) -> DataFrame:
    """A4: ``(group, draw, id1, id2)``; each draw is a
    uniform 2-subset of its group (ordered as drawn); draws may repeat."""
    mem = ranked_members(df, group, id_col, seed)
    sizes = mem.groupBy(group).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= 2)
    last = F.least(F.lit(draws_per_group).cast("bigint"), F.col("m")) - 1
    draws = sizes.select(group, "m", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("draw"))
    r1, r2 = _two_distinct(h60(seed, "same", F.col(group), F.col("draw"), 1),
                           h60(seed, "same", F.col(group), F.col("draw"), 2), F.col("m"))
    draws = draws.select(group, "draw", r1.alias("r1"), r2.alias("r2"))
    a = mem.select(F.col(group), F.col("rank").alias("r1"), F.col(id_col).alias("id1"))
    b = mem.select(F.col(group), F.col("rank").alias("r2"), F.col(id_col).alias("id2"))
    return draws.join(a, [group, "r1"]).join(b, [group, "r2"]).select(group, "draw", "id1", "id2")


# --- FIXED VALUES: two primes; one of them is coprime to any number of pairs below their product ---
STEP_PRIMES = (2147483647, 2147483629)
ORDINAL_BUCKETS = 4096


def pair_space(mem: DataFrame, group: str, seed: int) -> tuple[DataFrame, int]:
    """The same-group pairs of ranked members, numbered but never listed: a group of m
    members owns m(m-1)/2 consecutive ordinals from ``__first`` on, a running sum over the
    group table.  Also the number of all pairs."""
    from penmark.session import cut_lineage
    sizes = mem.groupBy(group).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= 2) \
               .withColumn("__pairs", F.expr("m * (m - 1) div 2"))
    space = cut_lineage(running_offsets(sizes, "__pairs", h60(seed, "space", F.col(group)), F.col(group), "__first"))
    return space, space.agg(F.sum("__pairs").alias("n")).first().n or 0


def pairs_of_ordinals(draws: DataFrame, mem: DataFrame, space: DataFrame, total: int, group: str, id_col: str) -> DataFrame:
    """``(group, draw, id1, id2)`` of rows (draw, __o): the ordinal names its group and two ranks, and
    equi-joins find the members.  Ordinals meet their groups by equal slices of the range."""
    width = max(1, -(-total // ORDINAL_BUCKETS))
    draws = draws.withColumn("__slice", F.expr(f"__o div {width}"))
    slices = space.withColumn("__slice", F.explode(F.sequence(
        F.expr(f"__first div {width}"), F.expr(f"(__first + __pairs - 1) div {width}"))))
    # draws are shuffled to their slices, never broadcast
    own = draws.hint("merge").join(slices, "__slice").where((F.col("__o") >= F.col("__first")) & (F.col("__o") < F.col("__first") + F.col("__pairs")))
    o = F.col("__o") - F.col("__first")
    # ordinal o is the pair (i, j), i < j, with o = j(j-1)/2 + i; the root is set right by one step
    j = F.floor((F.sqrt(o * 8.0 + 1.0) + 1.0) / 2.0).cast("bigint")
    own = own.select(group, "draw", o.alias("__l"), j.alias("__j"))
    fix = (F.when(F.expr("__j * (__j - 1) div 2") > F.col("__l"), F.col("__j") - 1)
           .when(F.expr("__j * (__j + 1) div 2") <= F.col("__l"), F.col("__j") + 1).otherwise(F.col("__j")))
    own = own.withColumn("__j", fix).withColumn("__i", F.col("__l") - F.expr("__j * (__j - 1) div 2"))
    a = mem.select(F.col(group), F.col("rank").alias("__i"), F.col(id_col).alias("id1"))
    b = mem.select(F.col(group), F.col("rank").alias("__j"), F.col(id_col).alias("id2"))
    return own.join(a, [group, "__i"]).join(b, [group, "__j"]).select(group, "draw", "id1", "id2")


def distinct_group_pairs(df: DataFrame, group: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A1: ``(group, draw, id1, id2)`` for ``min(n, total)`` *different*
    same-group pairs, every pair of the whole table equally likely.  Draw d takes the ordinal
    (d * prime + shift) mod total of the pair space, a permutation of all ordinals."""
    mem = ranked_members(df, group, id_col, seed)
    space, total = pair_space(mem, group, seed)
    prime = next((p for p in STEP_PRIMES if total % p), 1)
    draws = df.sparkSession.range(min(n, total)).select(
        F.col("id").alias("draw"),
        ((F.col("id").cast("decimal(19,0)") * prime + seed) % max(total, 1)).cast("bigint").alias("__o"))
    return pairs_of_ordinals(draws, mem, space, total, group, id_col)


RANGE_DRAWS = 1024      # pairs expected in one range of ordinals
SLICE_RANGES = 64       # ranges of a slice at least
MOST_SLICES = 512       # a slice gets the ids of the groups that it lies in: no more slices, so that these copies follow the rows
BLOCK_RANKS = 4096      # ids of a block
WALK_RANGES = 32        # ranges whose draws make an output batch


def taken_ordinals(r: int, width: int, total: int, share: float, seed: int):
    """The ordinals of a Bernoulli sample that lie in range ``r``, ascending: by geometric gaps from one
    ordinal taken to the next, so no ordinal is looked at in between."""
    import hashlib
    import math

    import numpy as np
    start, end = r * width, min(total, (r + 1) * width)
    missed = math.log1p(-share) if share < 1 else -math.inf
    prefix, found, at, i, n = f"{seed}|gap|{r}|".encode(), [], start - 1, 0, RANGE_DRAWS + 64
    while at < end:
        raw = b"".join([hashlib.md5(prefix + b"%d" % k).digest() for k in range(i, i + n)])
        u = (np.frombuffer(raw, ">u8")[::2] >> np.uint64(4)) / float(1 << 60)
        with np.errstate(divide="ignore"):
            gaps = np.minimum(np.floor(np.log1p(-u) / missed), width)
        found.append(at + np.cumsum(gaps.astype(np.int64) + 1))
        at, i, n = int(found[-1][-1]), i + n, 64
    taken = np.concatenate(found)
    return taken[taken < end]


def rows_of_ordinals(o):
    """j of the ordinals j(j-1)/2 + i, 0 <= i < j; the root is set right by one step."""
    import numpy as np
    j = np.floor((np.sqrt(o * 8.0 + 1.0) + 1.0) / 2.0).astype(np.int64)
    return j - (j * (j - 1) // 2 > o) + (j * (j + 1) // 2 <= o)


def slice_parts(mem: DataFrame, space: DataFrame, group: str, id_col: str, width: int) -> DataFrame:
    """(__slice, group, __first, __block, __ids): the ids, by rank, of those blocks of ``BLOCK_RANKS`` ranks that pairs of
    a slice of ``width`` ordinals can be members of, and the first ordinal of their group."""
    def row(o: str) -> str:
        j = f"CAST(floor((sqrt({o} * 8.0D + 1.0D) + 1.0D) / 2.0D) AS BIGINT)"
        return f"({j} - CAST({j} * ({j} - 1) div 2 > {o} AS BIGINT) + CAST({j} * ({j} + 1) div 2 <= {o} AS BIGINT))"

    own = space.select(group, "__first", "__pairs", F.explode(F.expr(f"sequence(__first div {width}, (__first + __pairs - 1) div {width})")).alias("__slice"))
    own = own.withColumn("__lo", F.expr(f"greatest(0, __slice * {width} - __first)")) \
             .withColumn("__hi", F.expr(f"least(__pairs, (__slice + 1) * {width} - __first) - 1"))
    own = own.withColumn("__j0", F.expr(row("__lo"))).withColumn("__j1", F.expr(row("__hi")))
    # a slice within one j has a run of i; otherwise every lower rank may be an i
    tri, n = "__j0 * (__j0 - 1) div 2", BLOCK_RANKS
    blocks = F.expr(f"CASE WHEN __j0 = __j1 THEN array_union(sequence((__lo - {tri}) div {n}, (__hi - {tri}) div {n}), array(__j0 div {n})) "
                    f"ELSE sequence(0L, __j1 div {n}) END")
    own = own.select("__slice", group, "__first", F.explode(blocks).alias("__block"))
    ids = mem.groupBy(group, F.expr(f"rank div {n}").alias("__block")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).alias("id")))).alias("__m"))
    return own.join(ids.select(group, "__block", F.transform("__m", lambda x: x["id"]).alias("__ids")), [group, "__block"]) \
              .select("__slice", group, "__first", "__block", "__ids")


def sampled_group_pairs(df: DataFrame, group: str, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """``(group, draw, id1, id2)``, every same-group pair with probability
    ``share`` (0 < share <= 1); the sample follows the number of pairs, which is never listed.

    Draws are made where they are returned: what is shuffled are the members' ids, to the slices of
    the pair space that need them, and a slice walks its ranges one after the other."""
    if not 0 < share <= 1:
        raise ValueError(f"share {share} is not in (0, 1]")
    mem = ranked_members(df, group, id_col, seed)
    space, total = pair_space(mem, group, seed)
    width = max(1, round(RANGE_DRAWS / share))
    ranges = -(-total // width)
    per = max(SLICE_RANGES, -(-ranges // MOST_SLICES))
    n = max(1, -(-ranges // per))

    def pairs_in(number: int, parts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        parts = pa.Table.from_batches(parts)
        parts = parts.take(pc.sort_indices(parts, [("__first", "ascending"), ("__block", "ascending")])).combine_chunks()
        first, block = parts["__first"].to_numpy(), parts["__block"].to_numpy()
        lists = parts["__ids"].chunk(0)
        ids, starts = lists.flatten(), np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy()))[:-1]
        firsts, lead, of = np.unique(first, return_index=True, return_inverse=True)
        names = parts[group].chunk(0).take(pa.array(lead))
        key = of << 32 | block

        def member(g, rank):
            at = np.searchsorted(key, g << 32 | rank // BLOCK_RANKS)
            return ids.take(pa.array(starts[at] + rank % BLOCK_RANKS))

        for r in range(number * per, min(ranges, (number + 1) * per), WALK_RANGES):
            o = np.concatenate([taken_ordinals(k, width, total, share, seed) for k in range(r, min(ranges, (number + 1) * per, r + WALK_RANGES))])
            g = np.searchsorted(firsts, o, side="right") - 1
            local = o - firsts[g]
            j = rows_of_ordinals(local)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(g)), pa.array(o), member(g, local - j * (j - 1) // 2), member(g, j)], names=[group, "draw", "id1", "id2"])

    def walk(batches):
        number, held = None, []
        for b in batches:
            column, at = b.column(0).to_numpy(), 0
            while at < len(column):         # rows of a slice are neighbours
                if column[at] != number and held:
                    yield from pairs_in(number, held)
                    held = []
                number, end = int(column[at]), at
                while end < len(column) and column[end] == number:
                    end += 1
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield from pairs_in(number, held)

    parts = slice_parts(mem, space, group, id_col, per * width)
    # both sides are dealt out by hand: the merge join's partitions stay as they are, however few bytes the ids have
    slices = df.sparkSession.range(n).select(F.col("id").alias("__slice")).repartition(n, "__slice").hint("merge")
    rows = slices.join(parts.repartition(n, "__slice"), "__slice")
    kind = {c: mem.schema[c].dataType.simpleString() for c in (group, id_col)}
    return rows.mapInArrow(walk, f"`{group}` {kind[group]}, draw bigint, id1 {kind[id_col]}, id2 {kind[id_col]}")


def cross_group_pairs(df: DataFrame, group: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """A2/A5: ``(draw, group1, group2, id1, id2)`` for ``n`` draws; empty when
    there are fewer than two groups."""
    spark = df.sparkSession
    mem = ranked_members(df, group, id_col, seed)
    sizes = mem.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    from penmark.session import cut_lineage
    # one row per group, read three times: materialise once
    groups = cut_lineage(hash_rank(sizes, [], h60(seed, "g", F.col(group)), F.col(group), out="grank"))
    n_groups = groups.select(F.count(F.lit(1))).scalar()
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn("__g", n_groups)
    g1, g2 = _two_distinct(h60(seed, "cross", F.col("draw"), 1), h60(seed, "cross", F.col("draw"), 2),
                           F.col("__g"))
    draws = draws.where(F.col("__g") >= 2).select("draw", g1.alias("gr1"), g2.alias("gr2"))
    ga = groups.select(F.col("grank").alias("gr1"), F.col(group).alias("group1"), F.col("m").alias("m1"))
    gb = groups.select(F.col("grank").alias("gr2"), F.col(group).alias("group2"), F.col("m").alias("m2"))
    d = draws.join(ga, "gr1").join(gb, "gr2")
    d = d.select("draw", "group1", "group2",
                 F.pmod(h60(seed, "pick", F.col("draw"), 1), F.col("m1")).alias("r1"),
                 F.pmod(h60(seed, "pick", F.col("draw"), 2), F.col("m2")).alias("r2"))
    a = mem.select(F.col(group).alias("group1"), F.col("rank").alias("r1"), F.col(id_col).alias("id1"))
    b = mem.select(F.col(group).alias("group2"), F.col("rank").alias("r2"), F.col(id_col).alias("id2"))
    return d.join(a, ["group1", "r1"]).join(b, ["group2", "r2"]).select("draw", "group1", "group2", "id1", "id2")


def labelled_pairs(same: DataFrame, diff: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """Union of same (label 1) and different (label 0) pairs in a
    seeded shuffled order, numbered by ``pair_id``."""
    s = same.select("id1", "id2", F.lit(1).alias("label"),
                    F.concat_ws("/", F.lit("same"), F.col(group), F.col("draw").cast("string")).alias("key"))
    d = diff.select("id1", "id2", F.lit(0).alias("label"),
                    F.concat_ws("/", F.lit("diff"), F.col("draw").cast("string")).alias("key"))
    ranked = hash_rank(s.unionByName(d), [], h60(seed, "shuffle", F.col("key")), F.col("key"), out="pair_id")
    return ranked.drop("key")


def with_pair_details(pairs: DataFrame, articles: DataFrame, id_col: str = "article_id",
                      cols: tuple[str, ...] = ("title", "author"), key: str = "pair_id") -> DataFrame:
    """Both ends' details (one lookup join, see ``attach_both``)."""
    return attach_both(pairs, articles, id_col, list(cols), key, prefixes=("article1_", "article2_"))


def attach_both(pairs: DataFrame, values: DataFrame, id_col: str, cols: list[str], key: str = "pair_id",
                left: str = "id1", right: str = "id2", prefixes=("a1_", "a2_")) -> DataFrame:
    """Look up ``cols`` of both ends of every pair with ONE join: each pair
    becomes two (key, side, id) rows, those are joined to ``values`` once and
    folded back per pair (two rows per group).  Joining twice would compute
    ``values`` twice -- the two sides' exchanges differ, so they are not
    reused."""
    ends = pairs.select(key, F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col(left).alias("__id")),
        F.struct(F.lit(2).alias("side"), F.col(right).alias("__id")))).alias("e")).select(key, "e.side", "e.__id")
    v = values.select(F.col(id_col).alias("__id"), *cols)
    j = ends.join(v, "__id")
    folded = j.groupBy(key).agg(*[F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True).alias(p + c)
                                  for s, p in ((1, prefixes[0]), (2, prefixes[1])) for c in cols],
                                F.count(F.lit(1)).alias("__n"))
    # inner-join semantics: both ends must exist
    return pairs.join(folded.where(F.col("__n") == 2).drop("__n"), key)


def pair_abs_diff(pairs: DataFrame, vectors: DataFrame, id_col: str, vec_col: str = "features") -> DataFrame:
    """``|f(id1) - f(id2)|`` element-wise; NULL stays NULL."""
    j = attach_both(pairs, vectors, id_col, [vec_col], prefixes=("__v1_", "__v2_"))
    diff = F.zip_with(f"__v1_{vec_col}", f"__v2_{vec_col}", lambda x, y: F.abs(x - y))
    return j.select(*pairs.columns, diff.alias("diff"))


def missing_cells(df: DataFrame, vec_col: str = "diff") -> DataFrame:
    """NULL/NaN cells of a vector column, their total and share."""
    bad = F.size(F.filter(vec_col, lambda v: v.isNull() | F.isnan(v)))
    return df.agg(F.sum(bad).cast("bigint").alias("n_missing"),
                  F.sum(F.size(vec_col)).cast("bigint").alias("n_cells")) \
             .withColumn("share", F.col("n_missing") / F.col("n_cells"))
