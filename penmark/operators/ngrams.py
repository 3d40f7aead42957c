"""Word n-gram TF-IDF and pairwise cosine similarity.

Semantics: lower-cased tokens of two or more word characters; unigrams and
bigrams; vocabulary = the ``max_features`` terms with the largest corpus
frequency (ties by term); weight = (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1),
then L2-normalised per document over the vocabulary terms.

Plan
----
fit        two map-only passes: frequent-item summaries of the words, one per task and
           merged, name candidates with an error bound; then only these words and the
           bigrams of two of them are counted exactly (``frequent_terms``): a bigram is at
           most as frequent as either of its words.  What crosses the network is a
           summary and the candidates' counts from each partition, however many
           different n-grams there are.  ``term_stats``, one row per term, is left for
           tables that are merged later (``fitstate``) and as the way out when no summary decides.
transform  map-side only: Spark ML's ``CountVectorizerModel`` counts the
           vocabulary terms of each document in the JVM, and array
           expressions turn counts into normalised weights.  No shuffle.
pairs      words are found once and stored; the counts of the fit are kept per document, so
           its weights come from them, and only non-zero weights meet their pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions.text import WORD

UNI = "__uni"
GRAMS = "__grams"


def unigrams(text) -> Column:
    """N1 tokens: lower-cased runs of at least two word characters."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(f"{WORD}{{2,}}"), F.lit(0))


def normalized_unigrams(text) -> Column:
    """``unigrams`` of what ``normalize_text`` made: lower-case words with one blank between two."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(t, " ", -1), lambda w: F.length(w) >= 2)


def with_ngrams(df: DataFrame, text_col: str = "text", out: str = GRAMS) -> DataFrame:
    """Append the uni+bigram array (N1); bigrams come from ML ``NGram``."""
    return grams_of_words(df.withColumn(UNI, unigrams(text_col)), out)


def grams_of_words(x: DataFrame, out: str = GRAMS) -> DataFrame:
    """The uni+bigram array of the word array, in its place."""
    x = NGram(n=2, inputCol=UNI, outputCol="__bi").transform(x)
    return x.withColumn(out, F.concat(F.col(UNI), F.col("__bi"))).drop(UNI, "__bi")


def term_stats(df: DataFrame, text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """Corpus frequency ``cf`` and document frequency ``df`` of every term, or of the
    given ones: then the others are dropped inside the arrays, before anything becomes a row."""
    return gram_stats(with_ngrams(df.select(text_col), text_col).select(GRAMS), only)


def gram_stats(g: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``term_stats`` of uni+bigram arrays."""
    if only is not None:
        # terms hold word characters and blanks only, so they need no escaping; a list this long is looked up by hash
        listed = ", ".join(f"'{t}'" for t in only)
        g = g.select(F.expr(f"filter({GRAMS}, t -> t in ({listed}))").alias(GRAMS))
    rows = F.concat(
        F.transform(F.col(GRAMS), lambda t: F.struct(t.alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct(F.col(GRAMS)),
                    lambda t: F.struct(t.alias("term"), F.lit(0).alias("c"), F.lit(1).alias("d"))))
    return (g.select(F.inline_outer(rows)).where(F.col("term").isNotNull())
            .groupBy("term").agg(F.sum("c").cast("bigint").alias("cf"), F.sum("d").cast("bigint").alias("df")))


def vocabulary(stats: DataFrame, max_features: int = 500) -> DataFrame:
    """Top ``max_features`` terms by corpus frequency, ties by term."""
    return stats.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(max_features)


TRACKED = 3 << 15           # items of a summary at first
MOST_TRACKED = 1_000_000    # the most a summary may track; beyond it every term is counted
# a summary that tracks m items has at least m / 0.75 slots and an error of at most 3.5 * N / slots over N items: it
# misses no item that occurs more often, and overrates none by more; merged summaries keep the bound
SUMMARY_ERROR = 3.5 * 0.75
MERGE_GROUPS = 1024         # tasks' summaries are merged in so many groups before the groups' are


def candidate_terms(grams: DataFrame, k: int, tracked: int) -> list[str] | None:
    """Terms that hold the ``k`` most frequent ones for sure, or None if the summary
    can't say.  Ties with the k-th are among them."""
    rows = grams.select(F.explode_outer(GRAMS).alias("term"), F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g"))
    parts = rows.where(F.col("term").isNotNull()).groupBy("g").agg(
        F.expr(f"approx_top_k_accumulate(term, {tracked})").alias("s"), F.count(F.lit(1)).alias("n"))
    # grouped by a constant: no words leave no row, where a total would combine no summary
    found = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("n")).where("n > 0") \
                 .select(F.expr(f"approx_top_k_estimate(s, {tracked})").alias("top"), "n")
    items = found.select(F.explode_outer("top").alias("t"), (F.col("n") * F.lit(SUMMARY_ERROR / tracked)).alias("error"),
                         F.get(F.col("top"), F.lit(k - 1))["count"].alias("kth"))
    # the k best true counts are at least kth - error; what is not tracked occurs at most error times
    decisive = (F.col("error") < 1) | F.coalesce(F.col("kth") - F.col("error") > F.col("error"), F.lit(False))
    rows = items.where(F.col("t").isNotNull()).select("t.item", decisive.alias("decisive")).where(
        F.coalesce(F.col("t.count") >= F.col("kth") - F.col("error"), F.lit(True))).collect()
    if rows and rows[0].decisive is False:
        return None
    return [r["item"] for r in rows]


def candidate_words(words: DataFrame, k: int, tracked: int) -> list[str] | None:
    """In order of their bytes, words that hold every word of the ``k`` most frequent terms for sure: ``k`` words occur as often
    as the k-th does, and a bigram of a rarer word occurs less often.  A larger
    summary is tried while the bound does not decide; None if none does."""
    listed = None
    while listed is None and tracked <= MOST_TRACKED:
        listed = candidate_terms(words.select(F.col(UNI).alias(GRAMS)), k, tracked)
        tracked *= 4
    return listed if listed is None else sorted(listed, key=str.encode)


def listed_counts(words: DataFrame, listed: list[str], id_col: str | None = None) -> DataFrame:
    """(id, codes, counts) per row: how often each listed word, and each bigram of two of them, occurs.  Word i has
    the code i * (n + 1), bigram (i, j) that plus j + 1; with the list in order of its bytes, codes are in the
    order of the terms, as a blank sorts before any word character."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        n = len(listed) + 1
        for b in batches:
            column = b.column(b.num_columns - 1)
            flat = column.flatten()
            at = pc.index_in(flat, value_set=pa.array(listed, type=flat.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows, dtype=np.int64), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
            one = np.flatnonzero(at >= 0)
            two = one[:-1][(np.diff(one) == 1) & (row[one[:-1]] == row[one[1:]])]
            codes = np.concatenate([at[one] * n, at[two] * n + at[two + 1] + 1])
            keys, counts = np.unique(np.concatenate([row[one], row[two]]) * (n * n) + codes, return_counts=True)
            bounds = pa.array(np.searchsorted(keys, np.arange(b.num_rows + 1, dtype=np.int64) * (n * n)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(keys % (n * n))), pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], names=[*b.schema.names[:-1], "codes", "counts"])

    ids = [id_col] if id_col else []
    kinds = "".join(f"`{c}` {words.schema[c].dataType.simpleString()}, " for c in ids)
    return words.select(*ids, UNI).mapInArrow(run, kinds + "codes array<bigint>, counts array<int>")


def frequent_codes(counts: DataFrame, k: int) -> list[tuple[int, int, int]]:
    """The ``k`` most frequent terms of ``listed_counts`` as (code, cf, df), best first, ties by code.  Tasks
    add up their batches before the shuffle."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            codes, at = np.unique(b.column(0).flatten().to_numpy(), return_inverse=True)
            cf = np.bincount(at, weights=b.column(1).flatten().to_numpy(), minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(cf), pa.array(np.bincount(at, minlength=len(codes)), pa.int64())],
                                             names=["code", "cf", "df"])

    sums = counts.select("codes", "counts").mapInArrow(run, "code bigint, cf bigint, df bigint") \
                 .groupBy("code").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    return [tuple(r) for r in sums.orderBy(F.col("cf").desc(), F.col("code").asc()).limit(k).collect()]    # k rows


def term_of(code: int, listed: list[str]) -> str:
    first, second = divmod(code, len(listed) + 1)
    return f"{listed[first]} {listed[second - 1]}" if second else listed[first]


def every_term(words: DataFrame, k: int) -> list:
    """The way out: the ``k`` most frequent terms with every term counted."""
    return [(r.term, r.cf, r.df) for r in vocabulary(gram_stats(grams_of_words(words.select(UNI)).select(GRAMS)), k).collect()]


def frequent_terms(df: DataFrame, text_col: str = "text", max_features: int = 500, tracked: int = TRACKED) -> tuple[list, int]:
    """The ``max_features`` most frequent terms as (term, cf, df), best first, ties by term, and the
    number of documents.  Counts are exact: the summary only chooses what to count.  If
    none decides, all terms are counted."""
    words = df.select(unigrams(text_col).alias(UNI))
    listed = candidate_words(words, max_features, tracked)
    if listed is None:
        return every_term(words, max_features), df.count()
    if not listed:
        return [], df.count()
    best = frequent_codes(listed_counts(words, listed), max_features)
    return [(term_of(c, listed), cf, n) for c, cf, n in best], df.count()


@dataclass
class TfidfModel:
    """A fitted vocabulary: ``terms`` in column order (alphabetical) with
    their idf; ``n_docs`` is the size of the fitted corpus."""
    terms: list[str]
    idf: list[float]
    n_docs: int

    def table(self, spark) -> DataFrame:
        """(pos, term, idf) registry of the vector columns."""
        return spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.idf))],
                                     "pos int, term string, idf double")

    def save(self, spark, path: str) -> None:
        """One row per term (bounded by the vocabulary size)."""
        self.table(spark).withColumn("n_docs", F.lit(self.n_docs).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> TfidfModel:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.pos)
        return TfidfModel([r.term for r in rows], [r.idf for r in rows], rows[0].n_docs if rows else 0)

    def transform(self, df: DataFrame, text_col: str = "text", out: str = "tfidf") -> DataFrame:
        """Normalised TF-IDF vector (``ARRAY<DOUBLE>`` over ``terms``);
        unknown terms are ignored; an empty document gives all zeros."""
        x = with_ngrams(df, text_col)
        cv = CountVectorizerModel.from_vocabulary(self.terms, inputCol=GRAMS, outputCol="__cnt")
        x = cv.transform(x).drop(GRAMS)
        idf = F.array(*[F.lit(float(v)) for v in self.idf])
        raw = F.zip_with(vector_to_array(F.col("__cnt")), idf,
                         lambda c, w: F.when(c > 0, (F.lit(1.0) + F.log(c)) * w).otherwise(F.lit(0.0)))
        x = x.withColumn("__raw", raw).drop("__cnt")
        norm = F.sqrt(F.aggregate(F.col("__raw"), F.lit(0.0), lambda a, v: a + v * v))
        # the divisor enters as an array, never as an outer column inside the
        # lambda: Catalyst may inline an outer alias into a lambda body, which
        # would re-evaluate it for every element
        x = x.withColumn("__norm", F.array_repeat(norm, len(self.terms)))
        vec = F.zip_with(F.col("__raw"), F.col("__norm"),
                         lambda v, n: F.when(n > 0, v / n).otherwise(F.lit(0.0)))
        return x.withColumn(out, vec).drop("__raw", "__norm")


def model_of(terms: list, n_docs: int) -> TfidfModel:
    """The model of (term, cf, df) rows: columns in alphabetical order, smooth idf."""
    vocab = sorted(terms, key=lambda r: r[0].encode("utf-8"))
    return TfidfModel([r[0] for r in vocab], [math.log((1 + n_docs) / (1 + r[2])) + 1.0 for r in vocab], n_docs)


def fit(df: DataFrame, text_col: str = "text", max_features: int = 500) -> TfidfModel:
    """N3 fit: vocabulary and smooth idf over the documents of ``df``."""
    return model_of(*frequent_terms(df, text_col, max_features))


def long_weights(df: DataFrame, model: TfidfModel, id_col: str, vec_col: str = "tfidf") -> DataFrame:
    """Sparse long form ``(id, term, weight)`` of the non-zero weights.  Zero
    cells are dropped inside the array, so only real entries become rows."""
    terms = F.array(*[F.lit(t) for t in model.terms])
    cells = F.filter(F.arrays_zip(terms.alias("term"), F.col(vec_col).alias("weight")), lambda c: c["weight"] != 0)
    return df.select(id_col, F.explode_outer(cells).alias("cell")).where(F.col("cell").isNotNull()) \
             .select(id_col, "cell.term", "cell.weight")


def fit_weights(words: DataFrame, id_col: str, max_features: int = 500, tracked: int = TRACKED) -> tuple[TfidfModel, DataFrame]:
    """N3 + N4 over words (``UNI``) that are stored or cheap to find: the model, and per row (id, tfidf) its non-zero weights as
    struct<at: columns, ascending; w: weights>.  The documents' counts are stored once; fit and weights read them."""
    from penmark.sources import files
    spark = words.sparkSession
    listed, best = candidate_words(words, max_features, tracked), None
    if listed is None:
        best = every_term(words, max_features)
        listed = sorted({w for t in best for w in t[0].split(" ")}, key=str.encode)
    counts = listed_counts(words, listed, id_col)
    counts = spark.read.schema(counts.schema).parquet(files.write_parquet(counts, files.scratch_path(spark, "term-counts"), compression="zstd"))
    if best is None:
        codes = frequent_codes(counts, max_features)
        best = [(term_of(c, listed), cf, n) for c, cf, n in codes]
    model = model_of(best, words.count())
    number = {w: i for i, w in enumerate(listed)}
    parts = [[number[w] for w in t.split(" ")] for t in model.terms]
    idfs = model.idf
    columns = [x[0] * (len(listed) + 1) + (x[1] + 1 if len(x) > 1 else 0) for x in parts]     # ascending

    def run(batches):
        import numpy as np
        import pyarrow as pa
        known, idf = np.array(columns + [-1], dtype=np.int64), np.array(idfs + [0.0])
        for b in batches:
            codes = b.column(1).flatten().to_numpy()
            at = np.searchsorted(known[:-1], codes)
            hit = known[at] == codes
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))[hit]
            at = at[hit]
            w = (1.0 + np.log(b.column(2).flatten().to_numpy()[hit])) * idf[at]
            w /= np.sqrt(np.bincount(row, weights=w * w, minlength=b.num_rows))[row]
            bounds = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            cells = [pa.ListArray.from_arrays(bounds, pa.array(at, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(w))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(cells, ["at", "w"])], names=[id_col, "tfidf"])

    kind = counts.schema[id_col].dataType.simpleString()
    return model, counts.mapInArrow(run, f"`{id_col}` {kind}, tfidf struct<at: array<int>, w: array<double>>")


def sparse_dots(ends: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, __dot): dot products of two columns of ``fit_weights``; a null vector gives 0."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def cells(column):
            at = pc.struct_field(column, "at")
            sizes = pc.list_value_length(at).fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(column), dtype=np.int64), sizes)
            return row, row << 32 | at.flatten().to_numpy(), pc.struct_field(column, "w").flatten().to_numpy()

        for b in batches:
            (row, a, v), (_, c, w) = cells(b.column(1)), cells(b.column(2))
            at = np.searchsorted(c, a)
            hit = np.append(c, -1)[at] == a
            dots = np.bincount(row[hit], weights=v[hit] * w[at[hit]], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dots, pa.float64())], names=[key, "__dot"])

    kind = ends.schema[key].dataType.simpleString()
    return ends.select(key, left, right).mapInArrow(run, f"`{key}` {kind}, __dot double")


def pair_cosine(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                left: str = "article1_idx", right: str = "article2_idx",
                max_features: int = 500) -> DataFrame:
    """Fit TF-IDF on the distinct documents named by the pairs, then the
    cosine of each pair (vectors are unit length, so cosine = dot product).

    One lookup join attaches the vectors (their non-zero cells, bounded by
    ``max_features``); pairs whose document has no vector get similarity 0.
    The documents are read once: their words are stored.
    """
    from penmark.operators.pairs import attach_both
    from penmark.sources import files
    spark = docs.sparkSession
    ids = pairs.select(F.col(left).alias(id_col)).union(pairs.select(F.col(right).alias(id_col))).distinct()
    words = docs.join(ids, id_col, "left_semi").select(id_col, unigrams(text_col).alias(UNI))
    words = spark.read.schema(words.schema).parquet(files.write_parquet(words, files.scratch_path(spark, "pair-words")))
    vec = fit_weights(words, id_col, max_features)[1]
    key = [c for c in pairs.columns if c not in (left, right)][0]
    ends = attach_both(pairs, vec, id_col, ["tfidf"], key, left, right, ("__v1_", "__v2_"))
    j = pairs.join(sparse_dots(ends, key, "__v1_tfidf", "__v2_tfidf"), key, "left")
    return j.select(*pairs.columns, F.coalesce("__dot", F.lit(0.0)).alias("word_ngram_similarity"))
