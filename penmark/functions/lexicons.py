"""Word lists and names whose values must stay exactly as they are.

FIXED VALUES: every list below is data that results depend on; entries are in
their natural order and must not be edited for style.
"""

from __future__ import annotations

# --- FIXED VALUES: function words by category (category order, word order) ---
FUNCTION_WORDS: dict[str, list[str]] = {
    "articles": ["a", "an", "the"],
    "prepositions": ["in", "on", "at", "of", "to", "with", "by", "for", "from", "about"],
    "conjunctions": ["and", "but", "or", "so", "yet", "nor", "because", "although", "since", "unless"],
    "pronouns": ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them"],
    "auxiliary_verbs": ["am", "is", "are", "was", "were", "be", "being", "been", "have", "has", "had",
                        "do", "does", "did", "will", "would", "shall", "should", "may", "might", "can",
                        "could"],
}

# --- FIXED VALUES: punctuation marks counted per character (name, mark) ---
PUNCTUATION_MARKS: list[tuple[str, str]] = [
    ("comma", ","),
    ("period", "."),
    ("question_mark", "?"),
    ("exclamation", "!"),
    ("semicolon", ";"),
    ("colon", ":"),
    ("dash", "-"),
    ("parenthesis_open", "("),
    ("parenthesis_close", ")"),
    ("quote", '"'),
    ("apostrophe", "'"),
]

# --- FIXED VALUES: English stop words (the standard NLTK English list, 179 words) ---
STOP_WORDS: list[str] = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# --- FIXED VALUES: Treebank contractions split into two tokens (whole word, split point) ---
TREEBANK_SPLITS: list[tuple[str, int]] = [
    ("cannot", 3), ("gimme", 3), ("gonna", 3), ("gotta", 3), ("lemme", 3), ("wanna", 3),
]

# --- FIXED VALUES: English month names, January = 1 ---
MONTHS: list[str] = ["January", "February", "March", "April", "May", "June", "July",
                     "August", "September", "October", "November", "December"]

# --- FIXED VALUES: output names of the five basic feature families, in output order ---
LEXICAL_FEATURES = ["avg_sentence_length", "avg_word_length", "lexical_diversity",
                    "sentence_count", "word_count", "unique_word_ratio"]
READABILITY_FEATURES = ["avg_words_per_sentence", "avg_sentence_length_chars",
                        "flesch_kincaid_grade", "automated_readability_index"]
STRUCTURE_FEATURES = ["paragraph_count", "avg_paragraph_length", "avg_paragraph_length_words",
                      "quote_frequency", "avg_quote_length"]

# --- FIXED VALUES: the seven fixed syntax feature names, in output order ---
SYNTAX_FEATURES = ["verb_noun_ratio", "adj_adv_ratio", "passive_voice_freq", "question_freq",
                   "complex_sentence_ratio", "compound_sentence_ratio", "avg_dependency_depth"]

# --- FIXED VALUES: metadata columns never used as model features ---
META_COLUMNS = ["Author", "Source", "NYT", "Genre", "PubDate", "Article Title", "Article Text",
                "URL", "index"]


def function_word_feature_names() -> list[str]:
    """62 names: per category its sum, then its words (category order kept)."""
    out: list[str] = []
    for cat, words in FUNCTION_WORDS.items():
        out.append(f"{cat}_freq")
        out.extend(f"{w}_freq" for w in words)
    return out


def punctuation_feature_names() -> list[str]:
    return [f"{name}_freq" for name, _ in PUNCTUATION_MARKS]


def basic_feature_names() -> list[str]:
    """The 88 basic feature names in output order (6 + 62 + 4 + 11 + 5)."""
    return (LEXICAL_FEATURES + function_word_feature_names() + READABILITY_FEATURES
            + punctuation_feature_names() + STRUCTURE_FEATURES)


def all_function_words() -> list[str]:
    seen: list[str] = []
    for words in FUNCTION_WORDS.values():
        for w in words:
            if w not in seen:
                seen.append(w)
    return seen
