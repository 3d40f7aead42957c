"""Quality classifier (operator 12): a sparse ensemble of rules.

A bounded sample of labelled rows (``TRAIN_ROWS``, drawn by a hash of the id; rows with
crc32(doc_id) mod 5 = 0 are never used) is split into three folds.  On the first,
shallow trees over text statistics are grown; every path from a root to a node is a
rule, a conjunction of threshold conditions.  On the second, logistic weights
of the rules are fitted under an L1 penalty, which leaves few rules with a weight; the third
chooses among the penalties.  The rules left are compiled into Spark column
expressions over the statistics: scoring is map-only and runs in the JVM after one
Arrow pass that takes the statistics of every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.llm.common import map_batches, stored
from penmark.llm.toxicity import held_out

TRAIN_ROWS = 20_000         # labelled rows drawn for training
TREES, DEPTH = 30, 3
PENALTIES = (0.005, 0.001)
LEAST_WEIGHT = 1e-6         # a rule with a smaller weight is left out
CUT = 0.3                   # predicted is 1 from this score on

SYMBOLS = b"*$@#%&|~^<>{}[]\\/=+_"
STOPS = b".,;:!?"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII = bytes(range(128))

STATISTICS = ["words", "word_length", "longest_word", "short_words", "distinct_words", "top_word", "distinct_pairs", "capitals",
              "symbols", "stops", "exclamations", "digits", "non_ascii", "lines", "line_words", "repeated_lines", "ended_lines",
              "packed_size"]

# one condition: (statistic number, "<=" or ">", threshold); a rule is a sorted tuple of conditions
Condition = tuple[int, str, float]
Rule = tuple[Condition, ...]


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; all 0 without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    counts = Counter(words)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
    return [math.log1p(n), sum(map(len, words)) / n, math.log1p(max(map(len, counts))), sum(len(w) <= 3 for w in words) / n,
            len(counts) / n, max(counts.values()) / n, (len(set(zip(words, words[1:]))) + 1) / n, share(CAPITALS),
            share(SYMBOLS), share(STOPS), share(b"!"), share(b"0123456789"), len(raw.translate(None, ASCII)) / size,
            math.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines),
            sum(x[-1] in b".!?" for x in lines) / len(lines), len(zlib.compress(raw, 1)) / size]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a column ``__s``: the statistics as an array of doubles."""
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            x = pa.array([statistics(t) for t in b.column(at).to_pylist()], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, x], names=[*b.schema.names, "__s"])

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField("__s", T.ArrayType(T.DoubleType()))]))


NODE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)")


def rules_of(described: str) -> list[Rule]:
    """Every path from the root to a node, of all trees in an ensemble's
    description.  Of several conditions of a path on the same side of one statistic the
    tightest stays; equal rules are listed once, in a fixed order."""
    found: set[Rule] = set()
    path: list[tuple[int, Condition]] = []
    for line in described.splitlines():
        m = NODE.match(line)
        if not m:
            continue
        depth, condition = len(m[1]), (int(m[2]), m[3], float(m[4]))
        path = [x for x in path if x[0] < depth] + [(depth, condition)]
        tight: dict[tuple[int, str], float] = {}
        for _, (s, side, at) in path:
            known = tight.get((s, side), at)
            tight[s, side] = min(known, at) if side == "<=" else max(known, at)
        found.add(tuple(sorted((s, side, at) for (s, side), at in tight.items())))
    return sorted(found)


def condition_sql(rule: Rule, stats: str = "__s") -> str:
    return " and ".join(f"{stats}[{s}] {side} {at!r}D" for s, side, at in rule)


def said(rule: Rule) -> str:
    return " and ".join(f"{STATISTICS[s]} {side} {at:.6g}" for s, side, at in rule)


class Model:
    """Weighted rules; without rules the score is the intercept's."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def probability(self, stats: str = "__s") -> Column:
        """The rules compiled into one column expression over the statistics."""
        parts = [f"if({condition_sql(rule, stats)}, {weight!r}D, 0D)" for rule, weight in self.rules]
        return F.expr(f"1 / (1 + exp(-({' + '.join([f'{self.intercept!r}D', *parts])})))")

    def table(self, spark) -> DataFrame:
        """The rules in words with their weights, heaviest first."""
        rows = [(said(r), w) for r, w in sorted(self.rules, key=lambda x: (-abs(x[1]), x[0]))]
        return spark.createDataFrame(rows, "rule string, weight double")

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``__score``."""
        return with_statistics(df, text).select(*df.columns, self.probability().alias("__score"))


def constant(share: float) -> Model:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model([], math.log(share / (1 - share)))


def log_loss(df: DataFrame, probability: Column, label: str) -> float:
    p = F.least(F.greatest(probability, F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.agg(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p)))).first()[0]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows.  Labels that are null or neither 0
    nor 1 are not used; of contradicting labels of a document the larger counts."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")) \
                  .where("doc_id is not null and y in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = stored(known.withColumn("h", F.xxhash64("doc_id", F.lit(29))).orderBy("h", "doc_id").limit(rows), "quality-drawn")
    # at most ``rows`` small rows
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    sample = stored(with_statistics(sample.withColumn("fold", F.pmod("h", F.lit(10)))).select("y", "fold", "__s"), "quality-sample")
    part = F.when(F.col("fold") < 4, 0).when(F.col("fold") < 8, 1).otherwise(2)
    seen = {r.part: (r.n, r.pos) for r in sample.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).collect()}
    if any(k not in seen or not 0 < seen[k][1] < seen[k][0] for k in range(3)):
        n, pos = (sum(x[i] for x in seen.values()) for i in (0, 1))
        return constant(pos / n if n else 0.0)
    x = sample.withColumn("y", F.col("y").cast("double")).withColumn("__x", array_to_vector("__s"))
    forest = RandomForestClassifier(featuresCol="__x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.5, minInstancesPerNode=5, seed=11)
    rules = rules_of(forest.fit(x.where("fold < 4").coalesce(4)).toDebugString)
    if not rules:
        return constant(seen[1][1] / seen[1][0])
    held = stored(sample.where("fold >= 4").select(F.col("y").cast("double").alias("y"), "fold", "__s", F.expr(
        f"array({', '.join(f'cast({condition_sql(r)} as double)' for r in rules)})").alias("__r")).coalesce(4), "quality-rules")
    held = held.withColumn("__v", array_to_vector("__r"))
    best = None
    for penalty in PENALTIES:
        lasso = LogisticRegression(featuresCol="__v", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=50,
                                   probabilityCol="__p").fit(held.where("fold < 8"))
        loss = log_loss(lasso.transform(held.where("fold >= 8")), vector_to_array("__p")[1], "y")
        if best is None or loss < best[0]:
            best = loss, lasso
    weights = best[1].coefficients.toArray().tolist()
    return Model([(r, w) for r, w in zip(rules, weights) if abs(w) > LEAST_WEIGHT], float(best[1].intercept))


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without words.  Repeated rows
    are scored each; a null doc_id is not held out and not trained on; an empty
    table gives no rows; without labels of both classes every score is the share of
    label 1 (next to 0 if there are none).  Other columns are not read."""
    out = fit(docs, labels, rows=rows).score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= CUT).cast("int").alias("predicted"))
