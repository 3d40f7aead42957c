"""Per-article basic style features.

All five families are computed in two projections over the scan -- no
shuffle, no Python.  The first projection materialises the token arrays once;
the second derives every feature from them.  Catalyst keeps the two projections
apart (a non-trivial alias used many times is not inlined), so each regex runs
once per document.

``mode="normalized"`` reproduces the reference pipeline (features of the
normalised text); ``mode="raw"`` computes the same formulas on the text as
given, which is what the formulas were written for.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions import text as T
from penmark.functions.lexicons import (
    FUNCTION_WORDS, LEXICAL_FEATURES, PUNCTUATION_MARKS, READABILITY_FEATURES,
    STRUCTURE_FEATURES, TREEBANK_SPLITS, all_function_words, basic_feature_names,
    function_word_feature_names, punctuation_feature_names,
)

_T = "__t"          # the text the features are computed on
_TOK = "__tok"      # treebank tokens
_WSP = "__wsp"      # \w+ words, original case, joined by ' '
_LSP = "__lsp"      # the same of the lower-cased text
_NWD = "__nwd"      # number of \w+ words, original case
_CHR = "__chr"      # their characters
_LWR = "__lwr"      # function words of the lower-cased text, joined as |w||w|
_NLW = "__nlw"      # number of \w+ words of the lower-cased text
_SNT = "__snt"      # sentence count
_PAR = "__par"      # stripped non-blank paragraphs
_QUO = "__quo"      # quoted spans
_SYL = "__syl"      # syllable total
_CNT = "__cnt_"     # prefix of a function word's count
_NST = "__nst"      # treebank tokens that are not stop words
HELPERS = [_T, _TOK, _WSP, _LSP, _NWD, _CHR, _LWR, _NLW, _SNT, _PAR, _QUO, _SYL, _NST]


def _ratio(num: Column, den: Column) -> Column:
    return (num.cast("double") / den.cast("double"))


def with_text(df: DataFrame, text_col: str = "text", mode: str = "normalized", ready: bool = False) -> DataFrame:
    if mode not in ("normalized", "raw"):
        raise ValueError(f"mode must be 'normalized' or 'raw', not {mode!r}")
    src = T.normalize_text(text_col) if mode == "normalized" and not ready else T.as_text(text_col)
    return df.withColumn(_T, src)


def _token_projection(df: DataFrame, families: set[str], mode: str = "raw") -> DataFrame:
    """Stage 1: compute each token array / count once.

    Normalised text holds only lower-case word characters separated by single
    spaces, so there: the text is its own list of words, it is its own
    lower-case form, and a non-empty text is one sentence and one paragraph
    without quotes -- the general regex forms give the same values, only
    slower."""
    t = F.col(_T)
    norm = mode == "normalized"
    empty = F.array().cast("array<string>")
    # the words are found once, in a projection of their own; everything counted on them reads plain spaces
    if families & {"function_words", "readability", "structure"}:
        df = df.withColumn(_WSP, t if norm else T.spaced_words(t))
        df = df.withColumn(_LSP, F.col(_WSP) if norm else T.lower_words(_WSP))
    cols: dict[str, Column] = {}
    if "lexical" in families:
        if norm:
            # normalised text is in lower case: plain searches say whether there is anything to split
            hint = reduce(or_, [t.contains(w) for w, _ in TREEBANK_SPLITS])
            s = F.when(hint, T.split_contractions(t)).otherwise(t)
            cols[_TOK] = F.when(t == "", empty).otherwise(F.split(s, " ", -1))
        else:
            cols[_TOK] = T.treebank_tokens(t)
    if families & {"lexical", "readability", "structure"}:
        cols[_SNT] = F.when(t == "", F.lit(0)).otherwise(F.lit(1)).cast("bigint") if norm else T.sentence_count(t)
    if families & {"readability", "structure"}:
        cols[_NWD] = T.spaced_count(_WSP)
    if "readability" in families:
        cols[_CHR] = T.spaced_length(_WSP)
        cols[_SYL] = T.spaced_syllables(_LSP)
    if "function_words" in families:
        lw = F.split(_LSP, " ", -1)
        fw = all_function_words()
        # function words only, each wrapped in its own '|' pair: |the||of|...
        cols[_LWR] = F.concat(F.lit("|"), F.array_join(F.filter(lw, lambda w: w.isin(fw)), "||"), F.lit("|"))
        cols[_NLW] = T.spaced_count(_LSP).cast("bigint")
    if "structure" in families:
        cols[_PAR] = F.when(t == "", empty).otherwise(F.array(t)) if norm else T.paragraphs(t)
        cols[_QUO] = empty if norm else T.quote_spans(t)
    return df.withColumns(cols)


def lexical_columns() -> list[Column]:
    """six lexical features; six zeros when there is no sentence or token."""
    tok = F.col(_TOK)
    n = F.size(tok).cast("bigint")
    nonstop = F.col(_NST)
    empty = (F.col(_SNT) == 0) | (n == 0)
    feats = {
        "avg_sentence_length": _ratio(n, F.col(_SNT)),
        "avg_word_length": _ratio(F.length(F.array_join(tok, "")), n),
        "lexical_diversity": F.when(F.size(nonstop) > 0,
                                    _ratio(F.size(F.array_distinct(nonstop)), F.size(nonstop)))
                              .otherwise(F.lit(0.0)),
        "sentence_count": F.col(_SNT),
        "word_count": n,
        "unique_word_ratio": _ratio(F.size(F.array_distinct(tok)), n),
    }
    out = []
    for name in LEXICAL_FEATURES:
        zero = F.lit(0).cast("bigint") if name in ("sentence_count", "word_count") else F.lit(0.0)
        out.append(F.when(empty, zero).otherwise(feats[name]).alias(name))
    return out


def function_word_columns() -> list[Column]:
    """share of each function word among lower-cased ``\\w+`` words, plus
    one share per category; zeros for an empty text.

    The counts come from ``_with_word_counts``.
    """
    n = {w: f"`{_CNT}{w}`" for w in all_function_words()}
    exprs: dict[str, str] = {}
    for cat, words in FUNCTION_WORDS.items():
        exprs[f"{cat}_freq"] = "(" + " + ".join(n[w] for w in words) + ")"
        for w in words:
            exprs[f"{w}_freq"] = n[w]
    return [F.expr(f"CASE WHEN {_NLW} = 0 THEN 0.0 ELSE CAST({exprs[name]} AS DOUBLE) / CAST({_NLW} AS DOUBLE) END")
            .alias(name) for name in function_word_feature_names()]


def _with_word_counts(df: DataFrame) -> DataFrame:
    """The number of each function word, counted once (its own share and its category's read it).

    Occurrences of ``w`` are counted as occurrences of ``|w|`` in the joined
    function-word string -- one native ``replace`` per word, no array copies,
    lengths in bytes.  The columns are written as SQL expressions (one JVM call each).
    """
    def count(w: str) -> str:
        marked = f"|{w}|"
        return (f"CAST((octet_length({_LWR}) - octet_length(replace({_LWR}, '{marked}', ''))) DIV {len(marked.encode())} AS BIGINT)"
                f" AS `{_CNT}{w}`")

    return df.selectExpr("*", *[count(w) for w in dict.fromkeys(all_function_words())])


def readability_columns() -> list[Column]:
    """words/sentence, chars/sentence, Flesch-Kincaid grade, ARI."""
    words, sents = F.col(_NWD).cast("double"), F.col(_SNT).cast("double")
    chars = F.col(_CHR).cast("double")
    syl = F.col(_SYL).cast("double")
    wps = words / sents
    feats = {
        "avg_words_per_sentence": wps,
        "avg_sentence_length_chars": chars / sents,
        "flesch_kincaid_grade": F.lit(0.39) * wps + F.lit(11.8) * (syl / words) - F.lit(15.59),
        "automated_readability_index": F.lit(4.71) * (chars / words) + F.lit(0.5) * wps - F.lit(21.43),
    }
    empty = (words == 0) | (sents == 0)
    return [F.when(empty, F.lit(0.0)).otherwise(feats[n]).alias(n) for n in READABILITY_FEATURES]


def punctuation_columns() -> list[Column]:
    """count of each mark / number of characters."""
    t = F.col(_T)
    n = F.length(t)
    return [F.when(n == 0, F.lit(0.0)).otherwise(_ratio(T.char_count(t, mark), n)).alias(f"{name}_freq")
            for name, mark in PUNCTUATION_MARKS]


def structure_columns() -> list[Column]:
    """paragraph count/length, quote frequency/length."""
    par, quo = F.col(_PAR), F.col(_QUO)
    npar = F.size(par).cast("bigint")
    nwords = F.col(_NWD)
    nquo = F.size(quo)
    par_chars = F.aggregate(par, F.lit(0).cast("bigint"), lambda acc, p: acc + F.length(p))
    quote_words = T.whitespace_word_count(F.array_join(quo, " "))
    feats = {
        "paragraph_count": npar,
        "avg_paragraph_length": _ratio(par_chars, npar),
        # words never span a blank line, so the per-paragraph word counts add
        # up to the word count of the whole text
        "avg_paragraph_length_words": _ratio(nwords, npar),
        "quote_frequency": _ratio(nquo, F.greatest(F.lit(1), nwords)),
        "avg_quote_length": _ratio(quote_words, F.greatest(F.lit(1), nquo)),
    }
    out = []
    for name in STRUCTURE_FEATURES:
        zero = F.lit(0).cast("bigint") if name == "paragraph_count" else F.lit(0.0)
        out.append(F.when(npar == 0, zero).otherwise(feats[name]).alias(name))
    return out


FAMILIES = {
    "lexical": lexical_columns,
    "function_words": function_word_columns,
    "readability": readability_columns,
    "punctuation": punctuation_columns,
    "structure": structure_columns,
}
FAMILY_ORDER = ["lexical", "function_words", "readability", "punctuation", "structure"]


def feature_columns_for(families) -> list[str]:
    names = {
        "lexical": LEXICAL_FEATURES,
        "function_words": function_word_feature_names(),
        "readability": READABILITY_FEATURES,
        "punctuation": punctuation_feature_names(),
        "structure": STRUCTURE_FEATURES,
    }
    return [n for fam in FAMILY_ORDER if fam in families for n in names[fam]]


def extract(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
            families=tuple(FAMILY_ORDER), mode: str = "normalized", ready: bool = False) -> DataFrame:
    """Append the requested feature families to ``keep`` columns.

    Row order and row count are those of ``df``; rows are keyed by whatever id
    column the caller keeps.  ``ready``: the texts are what ``normalize_text`` made.
    """
    fams = set(families)
    unknown = fams - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown feature families: {sorted(unknown)}")
    keep = list(keep if keep is not None else [c for c in df.columns if c != text_col])
    staged = _token_projection(with_text(df, text_col, mode, ready), fams, mode)
    if "lexical" in fams:
        staged = staged.withColumn(_NST, T.without_stopwords(F.col(_TOK)))
    if "function_words" in fams:
        staged = _with_word_counts(staged)
    cols = [F.col(c) for c in keep]
    for fam in FAMILY_ORDER:
        if fam in fams:
            cols.extend(FAMILIES[fam]())
    return staged.select(*cols)


def basic_features(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                   mode: str = "normalized", ready: bool = False) -> DataFrame:
    """All 88 basic features in reference order."""
    out = extract(df, text_col, keep, FAMILY_ORDER, mode, ready)
    assert out.columns[-88:] == basic_feature_names()
    return out


def lexical_features(df, text_col="text", keep=None, mode="normalized"):
    return extract(df, text_col, keep, ["lexical"], mode)


def function_word_features(df, text_col="text", keep=None, mode="normalized"):
    return extract(df, text_col, keep, ["function_words"], mode)


def readability_features(df, text_col="text", keep=None, mode="raw"):
    return extract(df, text_col, keep, ["readability"], mode)


def punctuation_features(df, text_col="text", keep=None, mode="raw"):
    return extract(df, text_col, keep, ["punctuation"], mode)


def structure_features(df, text_col="text", keep=None, mode="raw"):
    return extract(df, text_col, keep, ["structure"], mode)
