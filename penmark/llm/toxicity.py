"""Toxicity (operator 2): boosted trees over dense features, calibrated.

A bounded sample of labelled rows (``TRAIN_ROWS``, drawn by a hash of the id; rows
with crc32(doc_id) mod 5 = 0 are never used) is split into three folds: the
first teaches the lexicon (words and word beginnings that mark toxic
texts, by the z-score of their log odds), the second the boosted trees
(Spark ML), the third the isotonic calibration.  So the trees see lexicon
densities on texts that the lexicon was not learned from.

Scoring is map-only: dense features of every whole text in Arrow batches, then
the trees and the calibration in the JVM.  The inputs of a score come from the text alone.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.llm.common import map_batches, map_columns, stored, words_of

TRAIN_ROWS = 20_000         # labelled rows drawn for training
LEXICON_SIZE = 2_000
LEXICON_Z = 3.0             # least z-score of a lexicon entry
LEXICON_DOCS = 3            # least number of toxic texts that hold it
BEGINNINGS = (4, 5, 6)      # lengths of word beginnings tried beside whole words, in characters
NEAR = 5                    # words between a lexicon word and a second person
STRETCH = 50                # words of the densest stretch
TREES, DEPTH, STEP = 20, 4, 0.2
TIE_WEIGHT = 0.01           # share of the trees' own probability, which orders ties of the calibrated one

# --- FIXED VALUES: second-person words (English, German, French, Spanish) and look-alike characters ---
SECOND_PERSON = frozenset(w.encode() for w in (
    "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros vuestro su").split())
LOOKALIKE = bytes.maketrans(b"013457@$!", b"oieastasi")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOPS = b"!?.,;:"
SYMBOLS = b"*$@#%&"
HIDDEN = re.compile(rb"[A-Za-z][*$@#!0-9]+[A-Za-z][A-Za-z*$@#!0-9]*")

FEATURES = ["words", "hits", "density", "weighted_density", "strongest", "distinct", "stretch_density", "second_person",
            "near_second_person", "near_density", "capitals", "exclamations", "stops", "symbols", "digits", "hidden",
            "hidden_hits", "word_length"]


def terms_of(word: bytes) -> list[str]:
    """A word, and its beginnings marked by a star."""
    w = word.decode()
    return [w, *(w[:n] + "*" for n in BEGINNINGS if len(w) > n)]


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """z-scores of terms over labelled texts (text, toxic); at most ``LEXICON_SIZE`` of them."""
    def run(batches):
        for b in batches:
            counts: dict[str, list[int]] = {}
            for t, y in zip(b["text"], b["toxic"]):
                for term in {x for w in set(words_of(t)) for x in terms_of(w)}:
                    counts.setdefault(term, [0, 0])[y] += 1
            yield {"term": [*counts], "neg": [c[0] for c in counts.values()], "pos": [c[1] for c in counts.values()]}

    totals = sample.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    counts = map_columns(sample.select("text", "toxic"), run, "term string, neg bigint, pos bigint")
    counts = counts.groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(F.col("pos") >= LEXICON_DOCS)
    odds = F.log((F.col("pos") + 0.5) / (totals.pos + 1)) - F.log((F.col("neg") + 0.5) / (totals.neg + 1))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = counts.select("term", z.alias("z")).where(F.col("z") >= LEXICON_Z).orderBy(F.desc("z"), "term").limit(LEXICON_SIZE)
    return {r.term: r.z for r in best.collect()}


def lead(raw: bytes, at: int) -> int:
    """Start of the look-alike characters right before a position."""
    while at and raw[at - 1] in b"013457@$!":
        at -= 1
    return at


class Featurizer:
    """Dense features of a text under a lexicon."""

    def __init__(self, lexicon: dict[str, float], limit: int = 500_000):
        self.lexicon, self.limit = lexicon, limit
        self.weights: dict[bytes, float] = {}

    def weight(self, w: bytes) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms_of(w)), default=0.0)

    def __call__(self, text: str | None) -> list[float]:
        raw = (text or "").encode()
        words = words_of(text)
        if not words:
            return [0.0] * len(FEATURES)
        if len(self.weights) > self.limit:
            self.weights.clear()
        known = self.weights
        vocabulary = set(words)
        for w in vocabulary.difference(known):
            known[w] = self.weight(w)
        n = len(words)
        weight = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=n)
        at = np.flatnonzero(weight)
        near = person = 0
        if not vocabulary.isdisjoint(SECOND_PERSON):
            you = np.fromiter((i for i, w in enumerate(words) if w in SECOND_PERSON), dtype=np.int64)
            person = len(you)
            right = np.searchsorted(you, at)
            gap = np.minimum(np.abs(at - you[np.minimum(right, person - 1)]), np.abs(at - you[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR).sum())
        stretch = 0
        if len(at):     # most hits within a stretch of words that begins at a hit
            stretch = int((np.searchsorted(at, at + STRETCH) - np.arange(len(at))).max())
        without = lambda chars: len(raw) - len(raw.translate(None, chars))
        hidden = [raw[lead(raw, m.start()):m.end()] for m in HIDDEN.finditer(raw)]
        found = sum(self.weight(b"".join(words_of(h.translate(LOOKALIKE, b"*#").decode()))) > 0 for h in hidden)
        size = len(raw)
        return [math.log1p(n), float(len(at)), len(at) / n, float(weight.sum()) / n, float(weight.max()),
                float(len({words[i] for i in at.tolist()})), stretch / min(n, STRETCH), person / n, float(near), near / n,
                without(UPPER) / size, without(b"!") / size, without(STOPS) / size, without(SYMBOLS) / size,
                without(b"0123456789") / size, len(hidden) / n, float(found), size / n]


def with_features(df: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """``df`` with a column ``__x``: the dense features as an array of doubles."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    at = df.columns.index(text)

    def run(batches):
        f = Featurizer(shared.value)
        for b in batches:
            x = pa.array([f(t) for t in b.column(at).to_pylist()], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, x], names=[*b.schema.names, "__x"])

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField("__x", T.ArrayType(T.DoubleType()))]))


def held_out():
    """True where crc32(doc_id as text) mod 5 is 0; such rows' labels are never used."""
    return F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 5 == 0


class Model:
    """A fitted lexicon, trees and calibration, or a constant where there was nothing to learn."""

    def __init__(self, lexicon=None, trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``__score``."""
        if self.trees is None:
            return df.withColumn("__score", F.lit(float(self.constant)))
        x = with_features(df, self.lexicon, text).withColumn("__features", array_to_vector("__x"))
        x = self.calibration.transform(self.trees.transform(x).withColumn("__margin", vector_to_array("__raw")[1]))
        score = F.col("__calibrated") * (1 - TIE_WEIGHT) + vector_to_array("__probability")[1] * TIE_WEIGHT
        return x.select(*df.columns, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("__score"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows.  Labels that are null or neither 0
    nor 1 are not used; of contradicting labels of a document the larger counts."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
                  .where("doc_id is not null and toxic in (0, 1)").where(~held_out()) \
                  .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = stored(known.withColumn("h", F.xxhash64("doc_id", F.lit(17))).orderBy("h", "doc_id").limit(rows), "toxic-drawn")
    # at most ``rows`` small rows
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    sample = stored(sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic", F.pmod("h", F.lit(10)).alias("fold")),
                    "toxic-sample")
    seen = {r.part: (r.n, r.pos) for r in sample.groupBy(F.when(F.col("fold") < 5, 0).when(F.col("fold") < 8, 1).otherwise(2).alias("part"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos")).collect()}
    if any(k not in seen or not 0 < seen[k][1] < seen[k][0] for k in range(3)):
        n, pos = (sum(x[i] for x in seen.values()) for i in (0, 1))
        return Model(constant=pos / n if n else 0.0)
    lexicon = learn_lexicon(sample.where("fold < 5"))
    x = stored(with_features(sample.where("fold >= 5"), lexicon).drop("text"), "toxic-features")
    x = x.select("toxic", "fold", array_to_vector("__x").alias("__features")).coalesce(4)
    trees = GBTClassifier(featuresCol="__features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7,
                          predictionCol="__class").setRawPredictionCol("__raw").setProbabilityCol("__probability")
    trees = trees.fit(x.where("fold < 8"))
    margins = trees.transform(x.where("fold >= 8")).select("toxic", vector_to_array("__raw")[1].alias("__margin"))
    calibration = IsotonicRegression(featuresCol="__margin", labelCol="toxic", predictionCol="__calibrated").fit(
        margins.select(F.col("toxic").cast("double").alias("toxic"), "__margin"))
    return Model(lexicon, trees, calibration)


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without words.  Repeated rows
    are scored each; a null doc_id is not held out and not trained on; an empty
    table gives no rows; without labels of both classes every score is the share of
    label 1 (0 if there are none).  Other columns are not read."""
    out = fit(docs, labels, rows).score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the documents predicted toxic; columns unchanged."""
    model = fit(docs, labels, rows)
    # numbered names, so that no column can clash with the model's
    rows = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    text = f"__c{docs.columns.index('text')}"
    return model.score(rows, text).where("__score < 0.5").drop("__score").toDF(*docs.columns)
