"""Text column expressions (T-series).

Everything here returns a ``Column`` built from JVM-side functions, so it runs
inside whole-stage code generation next to the scan; nothing leaves the JVM.

Generators
----------
Exploding an expensive array uses the ``*_outer`` generators: for the plain
ones Catalyst infers a ``size(array) > 0`` filter and pushes it below the
projections, which re-evaluates the whole array expression there.

Regex dialect notes
-------------------
Java's ``\\w``/``\\s`` are ASCII-only, Python's are Unicode-aware.  The classes
below reproduce Python's meaning and are written so that RE2 (used by the SQL
oracle) reads them the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penmark.functions.lexicons import STOP_WORDS, TREEBANK_SPLITS

# Python-compatible character classes (bodies, usable inside [...]).
WORD_BODY = r"\p{L}\p{N}_"
SPACE_BODY = r"\s\x0b\x1c-\x1f\x85\p{Z}"

WORD = f"[{WORD_BODY}]"
SPACE = f"[{SPACE_BODY}]"
NONSPACE = f"[^{SPACE_BODY}]"
DIGITS = r"\p{Nd}+"
WORD_RUN = f"{WORD}+"
# a treebank token: a word run or one punctuation character
TOKEN_RUN = f"{WORD}+|[^{WORD_BODY}{SPACE_BODY}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_text(col) -> Column:
    """NULL -> '' and non-strings -> their string form."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def strip_ws(col) -> Column:
    """Python ``str.strip()``: trim Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), rf"\A{SPACE}+|{SPACE}+\z", "")


def normalize_text(col) -> Column:
    """Lower -> drop URLs -> drop non-word/non-space -> drop digits ->
    collapse whitespace -> strip, in exactly this order."""
    t = F.lower(as_text(col))
    t = F.regexp_replace(t, f"http{NONSPACE}+", "")
    # dropping non-word/non-space characters and then digit runs deletes each
    # character by its own class only, so one pass over the union does both
    t = F.regexp_replace(t, f"[\\p{{Nd}}[^{WORD_BODY}{SPACE_BODY}]]", "")
    t = F.regexp_replace(t, f"{SPACE}+", " ")
    return F.trim(t)  # only single ' ' can remain at the ends


def word_tokens(col) -> Column:
    """Maximal runs of word characters (``\\b\\w+\\b``)."""
    return F.regexp_extract_all(_c(col), F.lit(WORD_RUN), F.lit(0))


# a cheap pre-check: a text without these letters needs no contraction split
CONTRACTION_HINT = "(?i)cannot|gimme|gonna|gotta|lemme|wanna"


def split_contractions(col) -> Column:
    """Insert the Treebank split inside cannot/gimme/gonna/gotta/lemme/wanna."""
    heads = "|".join(f"{w[:k]}(?={w[k:]})" for w, k in TREEBANK_SPLITS)
    tails = "|".join(sorted({w[k:] for w, k in TREEBANK_SPLITS}))
    pattern = f"(?i)(?<!{WORD})({heads})(?=(?:{tails})(?!{WORD}))"
    return F.regexp_replace(_c(col), pattern, "$1 ")


def treebank_tokens(col) -> Column:
    """Treebank-style tokens.  Exact on normalised text (whitespace split
    plus the contraction splits); on raw text punctuation marks become
    one-character tokens."""
    return F.regexp_extract_all(split_contractions(col), F.lit(TOKEN_RUN), F.lit(0))


def sentence_pieces(col) -> Column:
    """T4: split on ``[.!?]+``, strip, drop blank pieces."""
    return F.filter(F.transform(F.split(_c(col), "[.!?]+"), strip_ws), lambda s: s != "")


def sentence_count(col) -> Column:
    """Number of non-blank pieces between sentence terminators."""
    return F.size(F.filter(F.split(_c(col), "[.!?]+"), lambda s: s.rlike(NONSPACE))).cast("bigint")


def paragraphs(col) -> Column:
    """T5: split on a literal blank line, strip, drop blanks."""
    return F.filter(F.transform(F.split(_c(col), "\n\n"), strip_ws), lambda s: s != "")


def quote_spans(col) -> Column:
    """Contents of ``"..."`` spans, in order."""
    return F.regexp_extract_all(_c(col), F.lit('"([^"]*)"'), F.lit(1))


def char_count(col, mark: str) -> Column:
    """Occurrences of one character."""
    c = _c(col)
    # lengths in bytes are stored, those in characters are counted
    gone = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(mark), F.lit("")))
    return (gone / len(mark.encode())).cast("bigint")


def whitespace_word_count(col) -> Column:
    """``len(s.split())``: runs of non-whitespace."""
    return F.regexp_count(_c(col), F.lit(f"{NONSPACE}+")).cast("bigint")


def syllables(word) -> Column:
    """T8 syllable estimate for one word."""
    w = F.lower(_c(word))
    stem = F.regexp_replace(w, "(es|ed|e)$", "")
    groups = F.regexp_count(stem, F.lit("[aeiouy]+"))
    return F.when(F.length(w) <= 3, F.lit(1)).otherwise(F.greatest(F.lit(1), groups)).cast("bigint")


def total_syllables(col) -> Column:
    """Sum of T8 over all ``\\w+`` words of a text, computed on the whole text.

    Each word is rewritten in place -- words of at most three characters become
    ``a`` (one vowel group), longer words lose an ``es``/``ed``/``e`` ending --
    then vowel groups are counted over the text, plus one for every word left
    without a vowel (the ``max(1, .)`` rule).  Vowel groups never cross words,
    because words are separated by non-word characters.
    """
    t = F.lower(_c(col))
    t = F.regexp_replace(t, f"(?<!{WORD}){WORD}{{1,3}}(?!{WORD})", "a")
    t = F.regexp_replace(t, f"(?:es|ed|e)(?!{WORD})", "")
    # one pass counts both: a vowel group, or a whole word without a vowel
    # (the two kinds of match never overlap)
    return F.regexp_count(t, F.lit(f"[aeiouy]+|(?<!{WORD})[{WORD_BODY}&&[^aeiouy]]+(?!{WORD})")).cast("bigint")


def spaced_words(col) -> Column:
    """The ``\\w+`` words in order, one ' ' between two: one pass, and later ones need no Unicode classes."""
    return F.trim(F.regexp_replace(_c(col), f"[^{WORD_BODY}]+", " "))


def lower_words(spaced) -> Column:
    """Spaced words in lower case, as the words of the lower-cased text: a capital I with
    a dot becomes two characters, and the second one is in no word."""
    low = F.lower(_c(spaced))
    return F.when(low.contains("\u0307"), spaced_words(low)).otherwise(low)


def spaced_length(spaced) -> Column:
    """Characters of spaced words."""
    return F.length(F.replace(_c(spaced), F.lit(" "), F.lit("")))


def spaced_count(spaced) -> Column:
    """Number of spaced words."""
    w = _c(spaced)
    return F.when(w == "", F.lit(0)).otherwise(F.octet_length(w) - F.octet_length(F.replace(w, F.lit(" "), F.lit(""))) + 1)


# T8 of lower-case spaced words, a match per syllable: a short word; a word without a vowel before its es/ed/e; a vowel group that is more than that e
SYLLABLE = (r"(?<![^ ])[^ ]{1,3}+(?![^ ])|(?<![^ ])[^ aeiouy]++(?:es|ed|e)?(?![^ ])|(?!e[sd]?(?![^ ]))[aeiouy]+")


def spaced_syllables(spaced) -> Column:
    """``total_syllables`` of lower-case spaced words in one pass."""
    return F.regexp_count(_c(spaced), F.lit(SYLLABLE)).cast("bigint")


def without_stopwords(tokens, stop_words: list[str] | None = None) -> Column:
    """Drop stop words, case-sensitive, duplicates kept."""
    stop = list(stop_words if stop_words is not None else STOP_WORDS)
    return F.filter(_c(tokens), lambda w: ~w.isin(stop))


def author_split(col) -> Column:
    """No-break space -> space; split on ', and ' / ' and ' / ', '."""
    return F.split(F.replace(_c(col), F.lit("\u00a0"), F.lit(" ")), ", and | and |, ")


def first_words(col, n: int) -> Column:
    """The first ``n`` whitespace-separated words of the first line."""
    first_line = F.substring_index(_c(col), "\n", 1)
    return F.array_join(F.slice(F.regexp_extract_all(first_line, F.lit(f"{NONSPACE}+"), F.lit(0)), 1, n), " ")


def path_part(col, n: int) -> Column:
    """The n-th (0-based, like Python) '/'-separated part, NULL if absent."""
    return F.try_element_at(F.split(_c(col), "/"), F.lit(n + 1))
