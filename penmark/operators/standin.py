"""The stand-in annotator of the tests (FIXTURES section 3): a fixed rule, not a parser."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

from penmark.functions.lexicons import FUNCTION_WORDS
from penmark.functions.text import SPACE_BODY, WORD_BODY

# --- FIXED VALUES: stand-in tagging rule word lists (FIXTURES section 3) ---
CCONJ = ["and", "but", "or", "nor", "so", "yet"]
SCONJ = ["because", "although", "since", "unless"]
# the stand-in's whole tag inventory, as any annotator publishes its own
POS = ["ADP", "AUX", "CCONJ", "DET", "NOUN", "NUM", "PRON", "PROPN", "SCONJ"]
DEP = ["ROOT", "aux", "auxpass", "cc", "dep", "det", "mark"]
ENT = ["ORG", "PERSON"]

PIECE = regex.compile(r"[^.!?]+[.!?]*")
WORD = regex.compile(f"[{WORD_BODY}]+")
NONSPACE = regex.compile(f"[^{SPACE_BODY}]")

# later lists give way to earlier ones
WORD_POS = {w: tag for tag, ws in reversed([("DET", FUNCTION_WORDS["articles"]), ("ADP", FUNCTION_WORDS["prepositions"]), ("CCONJ", CCONJ),
                                            ("SCONJ", SCONJ), ("PRON", FUNCTION_WORDS["pronouns"]),
                                            ("AUX", FUNCTION_WORDS["auxiliary_verbs"])]) for w in ws}
POS_DEP = {"SCONJ": "mark", "CCONJ": "cc", "DET": "det"}


@lru_cache(100_000)
def pos_of(word: str) -> tuple[str, str]:
    """The tag at the start of a sentence, and elsewhere."""
    known = WORD_POS.get(word.lower()) or ("NUM" if word.isdecimal() else None)
    if known:
        return known, known
    return "NOUN", "PROPN" if unicodedata.category(word[0]) == "Lu" else "NOUN"


def heads_of(sent: int, n: int) -> list[int]:
    """A binary tree, chains of eight or a star, by sentence."""
    shape = sent % 3
    if shape == 0:
        return [i // 2 for i in range(n)]
    if shape == 1:
        return [i - 1 if i % 8 else i // 8 for i in range(n)]
    return [0] * n


SHORT = 256             # tokens; the heads of shorter sentences are kept
short_heads = lru_cache(3 * SHORT)(heads_of)


def sentence_of(number: int, text: str) -> dict:
    words = WORD.findall(text)
    if not words:
        return {"text": text, "tokens": [], "ents": [], "chunks": []}
    n = len(words)
    pos = [t for _, t in map(pos_of, words)]
    pos[0] = pos_of(words[0])[0]
    dep = [POS_DEP.get(p, "dep") for p in pos]
    if "AUX" in pos:
        dep = [d if p != "AUX" else "aux" if i % 5 else "auxpass" for i, (p, d) in enumerate(zip(pos, dep))]
    dep[0] = "ROOT"
    names = [i for i, p in enumerate(pos) if p == "PROPN" and (i == 0 or pos[i - 1] != "PROPN")] if "PROPN" in pos else []
    chunks = [i for i, p in enumerate(pos[:-1]) if p == "DET" and pos[i + 1] in ("NOUN", "PROPN")] if "DET" in pos else []
    heads = short_heads(number % 3, n) if n < SHORT else heads_of(number, n)
    return {"text": text, "tokens": list(zip(words, pos, dep, heads)),
            "ents": [(i, "ORG" if i % 2 else "PERSON") for i in names], "chunks": chunks}


def annotator():
    """The factory for ``annotate.annotate``."""
    def run(texts: list[str]) -> list[list[dict]]:
        out = []
        for t in texts:
            kept = [s for s in PIECE.findall(t) if NONSPACE.search(s.rstrip(".!?"))]
            out.append([sentence_of(i, s) for i, s in enumerate(kept)])
        return out

    return run
