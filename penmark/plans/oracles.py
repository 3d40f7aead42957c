"""Independent DuckDB SQL for the registered queries (the correctness oracle).

These strings are written against the raw parquet views and do not share code
paths with the Spark plans: where the Spark side uses a shortcut (one regex
over the whole text, array_remove counts, ...) the SQL computes the quantity
the long way (per word, per paragraph), so agreement is a real check.
"""

from __future__ import annotations

from penmark.functions.lexicons import (
    FUNCTION_WORDS, LEXICAL_FEATURES, PUNCTUATION_MARKS, READABILITY_FEATURES, STOP_WORDS,
    STRUCTURE_FEATURES, TREEBANK_SPLITS, function_word_feature_names,
)
from penmark.functions.lexicons import SYNTAX_FEATURES as SYNTAX_FEATURES_
from penmark.operators.stats import SELECTED_FEATURES
from penmark.sources.tables import STYLE_PREFIX

ORACLES: dict[str, str] = {}

WB = r"\p{L}\p{N}_"
SB = r"\s\x0b\x1c-\x1f\x85\p{Z}"
NL = "chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE) * 1000000.0) / 1000000.0 + 0.0)"


def norm(x: str) -> str:
    t = f"lower(coalesce(CAST({x} AS VARCHAR), ''))"
    t = f"regexp_replace({t}, {q('http[^' + SB + ']+')}, '', 'g')"
    t = f"regexp_replace({t}, {q('[^' + WB + SB + ']')}, '', 'g')"
    t = f"regexp_replace({t}, {q(r'\p{Nd}+')}, '', 'g')"
    t = f"regexp_replace({t}, {q('[' + SB + ']+')}, ' ', 'g')"
    return f"trim({t})"


def styled(doc_id: str = "doc_id", text: str = "text") -> str:
    paras = f"replace({text}, {NL}, {NL} || {NL})"
    body = f"CASE WHEN {doc_id} % 3 = 0 THEN regexp_replace({paras}, '\\.', '?', 'g') ELSE {paras} END"
    return f"({q(STYLE_PREFIX)} || {body})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {q('[' + WB + ']+')})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(r'\A[' + SB + r']+|[' + SB + r']+\z')}, '', 'g')"


def tb_tokens_norm(t: str) -> str:
    """Treebank tokens of normalised text: split on ' ', then split the
    contraction words in two."""
    whole = ", ".join(q(w) for w, _ in TREEBANK_SPLITS)
    k = TREEBANK_SPLITS[0][1]
    assert all(s == k for _, s in TREEBANK_SPLITS)
    return (f"(CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE flatten(list_transform(string_split({t}, ' '), "
            f"lambda w: CASE WHEN w IN ({whole}) THEN [substr(w, 1, {k}), substr(w, {k + 1})] ELSE [w] END)) END)")


def tb_tokens_raw(t: str) -> str:
    """Treebank tokens of raw text: word runs and single marks, contraction words split in two."""
    whole = ", ".join(q(w) for w, _ in TREEBANK_SPLITS)
    k = TREEBANK_SPLITS[0][1]
    return (f"flatten(list_transform(regexp_extract_all({t}, {q('[' + WB + ']+|[^' + WB + SB + ']')}), "
            f"lambda w: CASE WHEN lower(w) IN ({whole}) THEN [substr(w, 1, {k}), substr(w, {k + 1})] ELSE [w] END))")


def sent_count(x: str) -> str:
    return (f"len(list_filter(regexp_split_to_array({x}, '[.!?]+'), "
            f"lambda s: regexp_matches(s, {q('[^' + SB + ']')})))")


def sent_pieces(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: {strip('s')}), "
            f"lambda s: s <> '')")


def paragraphs(x: str) -> str:
    return (f"list_filter(list_transform(string_split({x}, {NL} || {NL}), lambda p: {strip('p')}), "
            f"lambda p: p <> '')")


def quotes(x: str) -> str:
    return f"regexp_extract_all({x}, '\"([^\"]*)\"', 1)"


def syll(w: str) -> str:
    lw = f"lower({w})"
    return (f"(CASE WHEN length({lw}) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all("
            f"regexp_replace({lw}, '(es|ed|e)$', ''), '[aeiouy]+'))) END)")


def lsum_len(lst_sql: str, var: str = "x") -> str:
    return f"coalesce(list_sum(list_transform({lst_sql}, lambda {var}: length({var}))), 0)"


def articles_cte() -> str:
    title = (f"array_to_string(regexp_extract_all(split_part(text, {NL}, 1), {q('[^' + SB + ']+')})[1:5], ' ')")
    return f"""articles AS (
  SELECT doc_id AS article_id, source || '/' || lang AS author, source,
         TRY_CAST(substr(source, 4) AS INTEGER) < 10 AS is_target, lang AS genre,
         CASE WHEN doc_id % 17 = 0 THEN 'bad'
              ELSE CAST(doc_id % 12 + 1 AS VARCHAR) || '/' || CAST(doc_id % 28 + 1 AS VARCHAR) || '/2025' END
           AS pub_date_raw,
         {title} AS title, text
  FROM documents)"""


# ---------------------------------------------------------------- features

def feature_exprs(families: list[str]) -> list[tuple[str, str, bool]]:
    """(name, expr over stage columns, is_double)."""
    out: list[tuple[str, str, bool]] = []
    if "lexical" in families:
        n = "len(tok)"
        empty = f"(snt = 0 OR {n} = 0)"
        ns = f"list_filter(tok, lambda x: x NOT IN ({', '.join(q(w) for w in STOP_WORDS)}))"
        ex = {
            "avg_sentence_length": f"{n} / snt",
            "avg_word_length": f"{lsum_len('tok')} / {n}",
            "lexical_diversity": f"CASE WHEN len({ns}) > 0 THEN list_unique({ns}) / len({ns}) ELSE 0.0 END",
            "sentence_count": "snt",
            "word_count": n,
            "unique_word_ratio": f"list_unique(tok) / {n}",
        }
        for name in LEXICAL_FEATURES:
            if name in ("sentence_count", "word_count"):
                out.append((name, f"CAST(CASE WHEN {empty} THEN 0 ELSE {ex[name]} END AS BIGINT)", False))
            else:
                out.append((name, f"CASE WHEN {empty} THEN 0.0 ELSE {ex[name]} END", True))
    if "function_words" in families:
        ex = {}
        for cat, ws in FUNCTION_WORDS.items():
            ex[f"{cat}_freq"] = f"len(list_filter(lw, lambda x: x IN ({', '.join(q(w) for w in ws)})))"
            for w in ws:
                ex[f"{w}_freq"] = f"len(list_filter(lw, lambda x: x = {q(w)}))"
        for name in function_word_feature_names():
            out.append((name, f"CASE WHEN len(lw) = 0 THEN 0.0 ELSE {ex[name]} / len(lw) END", True))
    if "readability" in families:
        nw = "len(wrd)"
        chars = lsum_len("wrd")
        sy = f"coalesce(list_sum(list_transform(wrd, lambda w: {syll('w')})), 0)"
        wps = f"({nw} / snt)"
        ex = {
            "avg_words_per_sentence": wps,
            "avg_sentence_length_chars": f"{chars} / snt",
            "flesch_kincaid_grade": f"0.39 * {wps} + 11.8 * ({sy} / {nw}) - 15.59",
            "automated_readability_index": f"4.71 * ({chars} / {nw}) + 0.5 * {wps} - 21.43",
        }
        for name in READABILITY_FEATURES:
            out.append((name, f"CASE WHEN {nw} = 0 OR snt = 0 THEN 0.0 ELSE {ex[name]} END", True))
    if "punctuation" in families:
        for name, mark in PUNCTUATION_MARKS:
            cnt = f"(length(t) - length(replace(t, {q(mark)}, '')))"
            out.append((f"{name}_freq", f"CASE WHEN length(t) = 0 THEN 0.0 ELSE {cnt} / length(t) END", True))
    if "structure" in families:
        npar = "len(par)"
        pw = f"coalesce(list_sum(list_transform(par, lambda p: len({words('p')}))), 0)"
        qw = f"coalesce(list_sum(list_transform(quo, lambda z: len(regexp_extract_all(z, {q('[^' + SB + ']+')})))), 0)"
        ex = {
            "paragraph_count": npar,
            "avg_paragraph_length": f"{lsum_len('par', 'p')} / {npar}",
            "avg_paragraph_length_words": f"{pw} / {npar}",
            "quote_frequency": "len(quo) / greatest(1, len(wrd))",
            "avg_quote_length": f"{qw} / greatest(1, len(quo))",
        }
        for name in STRUCTURE_FEATURES:
            if name == "paragraph_count":
                out.append((name, f"CAST({npar} AS BIGINT)", False))
            else:
                out.append((name, f"CASE WHEN {npar} = 0 THEN 0.0 ELSE {ex[name]} END", True))
    return out


def stage_sql(src: str, id_cols: list[str], text_sql: str, mode: str, families: list[str]) -> str:
    t = norm(text_sql) if mode == "normalized" else f"coalesce({text_sql}, '')"
    ids = ", ".join(id_cols)
    cols = [f"{ids}", "t"]
    if "lexical" in families:
        cols.append(f"{tb_tokens_norm('t') if mode == 'normalized' else tb_tokens_raw('t')} AS tok")
    cols.append(f"{sent_count('t')} AS snt")
    cols.append(f"{words('t')} AS wrd")
    cols.append(f"{words('lower(t)')} AS lw")
    cols.append(f"{paragraphs('t')} AS par")
    cols.append(f"{quotes('t')} AS quo")
    return (f"SELECT {', '.join(cols)} FROM (SELECT {ids}, {t} AS t FROM {src}) s0")


def features_sql(src: str, id_cols: list[str], text_sql: str, mode: str, families: list[str],
                 round_doubles: bool = True) -> str:
    sel = [", ".join(id_cols)]
    for name, e, dbl in feature_exprs(families):
        sel.append(f"{r6(e) if (dbl and round_doubles) else e} AS {name}")
    return f"SELECT {', '.join(sel)} FROM ({stage_sql(src, id_cols, text_sql, mode, families)}) s1"


def styled_src() -> str:
    return f"(SELECT doc_id, {styled()} AS text FROM documents)"


# ---------------------------------------------------------------- queries

ORACLES["basic_features"] = features_sql(
    "documents", ["doc_id"], "text", "normalized",
    ["lexical", "function_words", "readability", "punctuation", "structure"])
ORACLES["lexical_features"] = features_sql(styled_src(), ["doc_id"], "text", "normalized", ["lexical"])
ORACLES["function_words"] = features_sql(styled_src(), ["doc_id"], "text", "normalized", ["function_words"])
ORACLES["readability"] = features_sql(styled_src(), ["doc_id"], "text", "raw", ["readability"])
ORACLES["punct_features"] = features_sql(styled_src(), ["doc_id"], "text", "raw", ["punctuation"])
ORACLES["structure_features"] = features_sql(styled_src(), ["doc_id"], "text", "raw", ["structure"])
ORACLES["raw_basic_features"] = features_sql(
    styled_src(), ["doc_id"], "text", "raw", ["function_words", "readability", "punctuation", "structure"])

ORACLES["mean_by_source"] = f"""
WITH {articles_cte()},
f AS ({features_sql('articles', ['article_id', 'source'], 'text', 'normalized',
                    ['lexical', 'function_words'], round_doubles=False)})
SELECT source, {', '.join(f'{r6(f"avg({c})")} AS {c}' for c in SELECTED_FEATURES)}
FROM f GROUP BY source"""

ORACLES["source_summary"] = f"""
WITH {articles_cte()},
f AS ({features_sql('articles', ['article_id', 'source'], 'text', 'normalized',
                    ['lexical', 'function_words'], round_doubles=False)})
SELECT 'count' AS section, source AS name, CAST(count(*) AS DOUBLE) AS value FROM f GROUP BY source
UNION ALL {' UNION ALL '.join(f"SELECT 'mean', source || ':{c}', {r6(f'avg({c})')} FROM f GROUP BY source" for c in SELECTED_FEATURES)}"""

ORACLES["normalize_text"] = f"SELECT doc_id, {norm('text')} AS norm_text FROM {styled_src()} s"


def digest_sql(arr: str, n: str, h: str, sep: str = " ") -> str:
    return (f"SELECT doc_id, CAST(len(a) AS BIGINT) AS {n}, md5(array_to_string(a, {q(sep)})) AS {h} "
            f"FROM (SELECT doc_id, {arr} AS a FROM {styled_src()} s) z")


ORACLES["word_tokens"] = digest_sql(words("text"), "n_words", "words_md5")
ORACLES["treebank_tokens"] = digest_sql(tb_tokens_norm(norm("text")), "n_tokens", "tokens_md5")
ORACLES["sentences"] = digest_sql(sent_pieces("text"), "n_sentences", "sentences_md5", "|")
ORACLES["quote_spans"] = digest_sql(quotes("text"), "n_quotes", "quotes_md5", "|")
ORACLES["stopword_filter"] = digest_sql(
    f"list_filter({tb_tokens_norm(norm('text'))}, lambda x: x NOT IN ({', '.join(q(w) for w in STOP_WORDS)}))",
    "n_content_tokens", "content_md5")

ORACLES["term_counts"] = (f"SELECT token, count(*) AS n FROM (SELECT unnest({words('lower(text)')}) AS token "
                          f"FROM documents) z GROUP BY token")
ORACLES["syllables"] = (f"SELECT word, CAST({syll('word')} AS BIGINT) AS syllables, count(*) AS n "
                        f"FROM (SELECT unnest({words('text')}) AS word FROM documents) z GROUP BY word")
ORACLES["source_distribution"] = (
    f"SELECT source, count(*) AS n, {r6('count(*) * 100.0 / (SELECT count(*) FROM documents)')} AS pct "
    f"FROM documents GROUP BY source")


def _long_lexical(features: list[str]) -> str:
    lex = features_sql("articles", ["article_id", "source"], "text", "normalized", ["lexical"], round_doubles=False)
    parts = [f"SELECT article_id, source, {q(c)} AS feature, CAST({c} AS DOUBLE) AS value FROM lex" for c in features]
    return f"WITH {articles_cte()}, lex AS ({lex}), long AS ({' UNION ALL '.join(parts)})"


_BOX = ["avg_word_length", "lexical_diversity", "word_count", "unique_word_ratio"]
ORACLES["box_stats"] = f"""{_long_lexical(_BOX)},
qs AS (SELECT source, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM long GROUP BY source, feature)
SELECT l.source, l.feature, {r6('qs.q1')} AS q1, {r6('qs.median')} AS median, {r6('qs.q3')} AS q3,
  {r6('min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END)')} AS whisker_lo,
  {r6('max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END)')} AS whisker_hi,
  CAST(count(*) FILTER (WHERE NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT)
    AS n_outliers
FROM long l JOIN qs USING (source, feature)
GROUP BY l.source, l.feature, qs.q1, qs.median, qs.q3"""

_CORR = ["avg_sentence_length", "avg_word_length", "lexical_diversity", "word_count"]
_corr_parts = []
for i, a in enumerate(_CORR):
    for b in _CORR[i + 1:]:
        _corr_parts.append(f"SELECT source, {q(a)} AS feature_x, {q(b)} AS feature_y, "
                           f"{r6(f'corr({a}, {b})')} AS corr FROM lex GROUP BY source")
ORACLES["feature_corr"] = (
    f"WITH {articles_cte()}, lex AS ("
    f"{features_sql('articles', ['source'], 'text', 'normalized', ['lexical'], round_doubles=False)}) "
    + " UNION ALL ".join(_corr_parts))

ORACLES["feature_histogram"] = f"""{_long_lexical(_BOX)},
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature)
SELECT source, l.feature,
  CAST(CASE WHEN hi = lo THEN 1 ELSE least(10, floor((value - lo) / (hi - lo) * 10) + 1) END AS BIGINT) AS bucket,
  count(*) AS n
FROM long l JOIN rng USING (feature) WHERE value IS NOT NULL GROUP BY ALL"""

_FENCED = f"""{_long_lexical(_BOX)},
qq AS (SELECT source, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY source, feature)"""
ORACLES["outlier_values"] = f"""{_FENCED}
SELECT source, feature, article_id, {r6('value')} AS value FROM long JOIN qq USING (source, feature)
WHERE NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""
_B = "CAST(CASE WHEN {r}.hi = {r}.lo THEN 1 ELSE least(10, floor(({v} - {r}.lo) / ({r}.hi - {r}.lo) * 10) + 1) END AS BIGINT)"
ORACLES["feature_joint"] = f"""{_long_lexical(_BOX)},
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature),
pair AS (SELECT x.source, x.feature AS feature_x, y.feature AS feature_y, x.value AS vx, y.value AS vy
         FROM long x JOIN long y ON x.article_id = y.article_id
         AND list_position({lst(_BOX)}, x.feature) < list_position({lst(_BOX)}, y.feature))
SELECT source, feature_x, feature_y, {_B.format(r='a', v='vx')} AS bucket_x, {_B.format(r='b', v='vy')} AS bucket_y, count(*) AS n
FROM pair JOIN rng a ON a.feature = feature_x JOIN rng b ON b.feature = feature_y
WHERE vx IS NOT NULL AND vy IS NOT NULL GROUP BY ALL"""

ORACLES["mean_fill"] = f"""
WITH lex AS ({features_sql('documents', ['doc_id'], 'text', 'normalized', ['lexical'], round_doubles=False)}),
h AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE avg_word_length END AS a,
             CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lexical_diversity END AS b FROM lex)
SELECT doc_id, {r6('coalesce(a, avg(a) OVER ())')} AS avg_word_length,
       {r6('coalesce(b, avg(b) OVER ())')} AS lexical_diversity FROM h"""


# ---------------------------------------------------------------- n-grams / TF-IDF

def grams_cte(src: str, id_col: str, text: str = "text") -> str:
    uni = f"regexp_extract_all(lower({text}), {q('[' + WB + ']{2,}')})"
    return (f"g AS (SELECT {id_col}, {uni} AS u FROM {src}), "
            f"gl AS (SELECT {id_col}, u || list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]) "
            f"AS grams FROM g)")


def vocab_cte(src: str = "documents", id_col: str = "doc_id", k: int = 500) -> str:
    return (f"{grams_cte(src, id_col)}, "
            f"tf AS (SELECT {id_col}, term, count(*) AS c FROM (SELECT {id_col}, unnest(grams) AS term FROM gl) z "
            f"GROUP BY ALL), "
            f"st AS (SELECT term, sum(c) AS cf, count(*) AS df FROM tf GROUP BY term), "
            f"vocab AS (SELECT term, CAST(cf AS BIGINT) AS cf, CAST(df AS BIGINT) AS df, "
            f"ln((1 + (SELECT count(*) FROM {src})) / (1 + df)) + 1 AS idf "
            f"FROM st ORDER BY cf DESC, term ASC LIMIT {k})")


ORACLES["ngrams"] = (f"WITH {grams_cte('documents', 'doc_id')} SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_grams, "
                     f"md5(array_to_string(grams, '|')) AS grams_md5 FROM gl")
ORACLES["vocab_topk"] = f"WITH {vocab_cte()} SELECT term, cf, df, {r6('idf')} AS idf FROM vocab"
ORACLES["merged_vocabulary"] = f"WITH {vocab_cte()} SELECT term, {r6('idf')} AS idf FROM vocab"
ORACLES["tfidf"] = f"""WITH {vocab_cte()},
w AS (SELECT doc_id, term, (1 + ln(c)) * idf AS w FROM tf JOIN vocab USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY doc_id)
SELECT doc_id, term, {r6('w / n')} AS weight FROM w JOIN nrm USING (doc_id)"""
ORACLES["tfidf_transform"] = f"""WITH {vocab_cte()},
bg AS (SELECT item_id, regexp_extract_all(lower(text), {q('[' + WB + ']{2,}')}) AS u FROM benchmark),
bgl AS (SELECT item_id, u || list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]) AS grams FROM bg),
btf AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(grams) AS term FROM bgl) z GROUP BY ALL),
w AS (SELECT item_id, term, (1 + ln(c)) * idf AS w FROM btf JOIN vocab USING (term)),
nrm AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM w GROUP BY item_id)
SELECT item_id, term, {r6('w / n')} AS weight FROM w JOIN nrm USING (item_id)"""


# ---------------------------------------------------------------- pairs

def H(*parts: str) -> str:
    """60-bit integer from md5 of the '|'-joined parts (SQL expressions)."""
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', {inner})), 1, 15) AS BIGINT)"


def members_cte(g: str, tag: str) -> str:
    return (f"mem_{tag} AS (SELECT {g} AS grp, article_id, row_number() OVER (PARTITION BY {g} "
            f"ORDER BY {H('42', 'article_id')}, article_id) - 1 AS rank FROM articles WHERE {g} IS NOT NULL)")


def same_pairs_cte(g: str, tag: str, k: int) -> str:
    return f"""{members_cte(g, tag)},
sz_{tag} AS (SELECT grp, count(*) AS m FROM mem_{tag} GROUP BY grp HAVING count(*) >= 2),
dr_{tag} AS (SELECT grp, m, unnest(range(0, least({k}, m))) AS draw FROM sz_{tag}),
d2_{tag} AS (SELECT grp, draw, {H('42', q('same'), 'grp', 'draw', '1')} % m AS r1,
                    {H('42', q('same'), 'grp', 'draw', '2')} % (m - 1) AS r2p FROM dr_{tag}),
same_{tag} AS (SELECT d.grp, d.draw, a.article_id AS id1, b.article_id AS id2
  FROM (SELECT grp, draw, r1, CASE WHEN r2p >= r1 THEN r2p + 1 ELSE r2p END AS r2 FROM d2_{tag}) d
  JOIN mem_{tag} a ON a.grp = d.grp AND a.rank = d.r1 JOIN mem_{tag} b ON b.grp = d.grp AND b.rank = d.r2)"""


def distinct_pairs_cte(g: str, tag: str) -> str:
    """As many different pairs as there are articles, at most all."""
    return f"""{members_cte(g, tag)},
sz_{tag} AS (SELECT grp, count(*) AS m FROM mem_{tag} GROUP BY grp HAVING count(*) >= 2),
sp_{tag} AS (SELECT grp, m * (m - 1) // 2 AS pairs,
                    sum(m * (m - 1) // 2) OVER (ORDER BY {H('42', q('space'), 'grp')}, grp) - m * (m - 1) // 2 AS first FROM sz_{tag}),
tt_{tag} AS (SELECT CAST(coalesce(sum(pairs), 0) AS BIGINT) AS total FROM sp_{tag}),
dr_{tag} AS (SELECT d AS draw, (d * (CASE WHEN total % 2147483647 <> 0 THEN 2147483647 ELSE 2147483629 END) + 42) % total AS o
             FROM (SELECT total, unnest(range(0, least(total, (SELECT count(*) FROM articles)))) AS d FROM tt_{tag}) t),
dl_{tag} AS (SELECT grp, draw, CAST(o - first AS BIGINT) AS l FROM dr_{tag} JOIN sp_{tag} ON o >= first AND o < first + pairs),
dj_{tag} AS (SELECT grp, draw, l, b.rank AS j, b.article_id AS id2 FROM dl_{tag} JOIN mem_{tag} b USING (grp)
             WHERE b.rank * (b.rank - 1) // 2 <= l AND b.rank * (b.rank + 1) // 2 > l),
same_{tag} AS (SELECT d.grp, d.draw, a.article_id AS id1, d.id2
  FROM dj_{tag} d JOIN mem_{tag} a ON a.grp = d.grp AND a.rank = d.l - d.j * (d.j - 1) // 2)"""


def diff_pairs_cte(tag: str) -> str:
    return f"""gs_{tag} AS (SELECT grp, count(*) AS m FROM mem_{tag} GROUP BY grp),
gr_{tag} AS (SELECT grp, m, row_number() OVER (ORDER BY {H('42', q('g'), 'grp')}, grp) - 1 AS grank FROM gs_{tag}),
ng_{tag} AS (SELECT count(*) AS ng FROM gr_{tag}),
cd_{tag} AS (SELECT unnest(range(0, (SELECT count(*) FROM same_{tag}))) AS draw),
cd2_{tag} AS (SELECT draw, {H('42', q('cross'), 'draw', '1')} % ng AS gr1,
                     {H('42', q('cross'), 'draw', '2')} % (ng - 1) AS gr2p FROM cd_{tag}, ng_{tag} WHERE ng >= 2),
cd3_{tag} AS (SELECT draw, gr1, CASE WHEN gr2p >= gr1 THEN gr2p + 1 ELSE gr2p END AS gr2 FROM cd2_{tag}),
cd4_{tag} AS (SELECT draw, ga.grp AS group1, gb.grp AS group2,
                     {H('42', q('pick'), 'draw', '1')} % ga.m AS r1, {H('42', q('pick'), 'draw', '2')} % gb.m AS r2
  FROM cd3_{tag} JOIN gr_{tag} ga ON ga.grank = cd3_{tag}.gr1 JOIN gr_{tag} gb ON gb.grank = cd3_{tag}.gr2),
diff_{tag} AS (SELECT draw, group1, group2, a.article_id AS id1, b.article_id AS id2 FROM cd4_{tag}
  JOIN mem_{tag} a ON a.grp = group1 AND a.rank = r1 JOIN mem_{tag} b ON b.grp = group2 AND b.rank = r2)"""


def labelled_cte(tag: str) -> str:
    return f"""lab_{tag} AS (SELECT id1, id2, label,
    row_number() OVER (ORDER BY {H('42', q('shuffle'), 'key')}, key) - 1 AS pair_id FROM (
  SELECT id1, id2, 1 AS label, concat_ws('/', 'same', grp, CAST(draw AS VARCHAR)) AS key FROM same_{tag}
  UNION ALL SELECT id1, id2, 0 AS label, concat_ws('/', 'diff', CAST(draw AS VARCHAR)) AS key FROM diff_{tag}) u)"""


ORACLES["same_source_pairs"] = (f"WITH {articles_cte()}, {same_pairs_cte('source', 's', 50)} "
                                f"SELECT grp AS source, draw, id1, id2 FROM same_s")
ORACLES["diff_source_pairs"] = (f"WITH {articles_cte()}, {same_pairs_cte('source', 's', 50)}, {diff_pairs_cte('s')} "
                                f"SELECT * FROM diff_s")
ORACLES["author_pairs_sampled"] = (f"WITH {articles_cte()}, {distinct_pairs_cte('author', 'a')} "
                                   f"SELECT grp AS author, draw, id1, id2 FROM same_a")
ORACLES["author_pairs_share"] = f"""WITH {articles_cte()}, {members_cte('author', 'a')},
sz AS (SELECT grp, count(*) AS m FROM mem_a GROUP BY grp HAVING count(*) >= 2),
sp AS (SELECT grp, m * (m - 1) // 2 AS pairs,
              sum(m * (m - 1) // 2) OVER (ORDER BY {H('42', q('space'), 'grp')}, grp) - m * (m - 1) // 2 AS first FROM sz),
tt AS (SELECT CAST(coalesce(sum(pairs), 0) AS BIGINT) AS total FROM sp),
rg AS (SELECT unnest(range(0, CAST(ceil(total / 4096) AS BIGINT))) AS r, total FROM tt),
gp AS (SELECT r, i, total, floor(ln(1 - {H('42', q('gap'), 'r', 'i')} / 1152921504606846976.0) / ln(0.75)) AS gap
       FROM (SELECT r, total, unnest(range(0, 4096)) AS i FROM rg) x),
od AS (SELECT r, total, CAST(r * 4096 + sum(gap) OVER (PARTITION BY r ORDER BY i) + i AS BIGINT) AS o FROM gp),
dl AS (SELECT grp, o, CAST(o - first AS BIGINT) AS l FROM od JOIN sp ON o >= first AND o < first + pairs
       WHERE o < least(total, (r + 1) * 4096)),
dj AS (SELECT grp, o, l, b.rank AS j, b.article_id AS id2 FROM dl JOIN mem_a b USING (grp)
       WHERE b.rank * (b.rank - 1) // 2 <= l AND b.rank * (b.rank + 1) // 2 > l)
SELECT d.grp AS author, d.o AS draw, a.article_id AS id1, d.id2
FROM dj d JOIN mem_a a ON a.grp = d.grp AND a.rank = d.l - d.j * (d.j - 1) // 2"""
ORACLES["diff_author_pairs"] = (f"WITH {articles_cte()}, {distinct_pairs_cte('author', 'a')}, {diff_pairs_cte('a')} "
                                f"SELECT * FROM diff_a")
_AUTHOR_LAB = f"{articles_cte()}, {distinct_pairs_cte('author', 'a')}, {diff_pairs_cte('a')}, {labelled_cte('a')}"
ORACLES["author_pair_table"] = f"""WITH {_AUTHOR_LAB}
SELECT pair_id, id1 AS article1_idx, id2 AS article2_idx, label AS same_author,
       x.title AS article1_title, y.title AS article2_title, x.author AS article1_author, y.author AS article2_author
FROM lab_a LEFT JOIN articles x ON x.article_id = id1 LEFT JOIN articles y ON y.article_id = id2"""

ORACLES["pair_cosine"] = f"""WITH {_AUTHOR_LAB},
ids AS (SELECT id1 AS article_id FROM lab_a UNION SELECT id2 FROM lab_a),
corpus AS (SELECT article_id, text FROM articles WHERE article_id IN (SELECT article_id FROM ids)),
{vocab_cte('corpus', 'article_id')},
w AS (SELECT article_id, term, (1 + ln(c)) * idf AS w FROM tf JOIN vocab USING (term)),
nrm AS (SELECT article_id, sqrt(sum(w * w)) AS n FROM w GROUP BY article_id),
wn AS (SELECT article_id, term, w / n AS w FROM w JOIN nrm USING (article_id)),
dots AS (SELECT pair_id, sum(a.w * b.w) AS s FROM lab_a JOIN wn a ON a.article_id = id1
         JOIN wn b ON b.article_id = id2 AND b.term = a.term GROUP BY pair_id)
SELECT pair_id, id1 AS article1_idx, id2 AS article2_idx, {r6('coalesce(s, 0.0)')} AS word_ngram_similarity
FROM lab_a LEFT JOIN dots USING (pair_id)"""

from penmark.functions.lexicons import basic_feature_names  # noqa: E402

_SOURCE_LAB = (f"{articles_cte()}, {same_pairs_cte('source', 's', 50)}, {diff_pairs_cte('s')}, {labelled_cte('s')}, "
               f"feats AS ({features_sql('articles', ['article_id'], 'text', 'normalized', ['lexical', 'function_words', 'readability', 'punctuation', 'structure'], round_doubles=False)})")
_DIFFS = ", ".join(f'abs(CAST(x.{c} AS DOUBLE) - CAST(y.{c} AS DOUBLE)) AS "{i}"' for i, c in enumerate(basic_feature_names()))
ORACLES["pair_abs_diff"] = f"""WITH {_SOURCE_LAB},
wide AS (SELECT pair_id, id1, id2, label, {_DIFFS}
         FROM lab_s JOIN feats x ON x.article_id = id1 JOIN feats y ON y.article_id = id2)
SELECT pair_id, id1, id2, label, CAST(pos0 AS BIGINT) AS pos, {r6('v0')} AS value
FROM (UNPIVOT wide ON {', '.join(f'"{i}"' for i in range(len(basic_feature_names())))} INTO NAME pos0 VALUE v0) u"""
ORACLES["store_pair_diff"] = ORACLES["pair_abs_diff"]
ORACLES["missing_cells"] = f"""WITH {_SOURCE_LAB},
cells AS (SELECT id1, id2, unnest(range({len(basic_feature_names())})) AS i FROM lab_s),
n AS (SELECT CAST(count(*) FILTER (WHERE i = 3 OR (id1 + i) % 11 = 0 OR (id2 + i) % 11 = 0) AS BIGINT) AS n_missing,
             count(*) AS n_cells FROM cells)
SELECT n_missing, n_cells, {r6('n_missing / n_cells')} AS share FROM n"""


# ---------------------------------------------------------------- preparation / evaluation

_NAMES = basic_feature_names()
_ALLF = ['lexical', 'function_words', 'readability', 'punctuation', 'structure']
_HOLED = f"""{articles_cte()},
feats AS ({features_sql('articles', ['article_id'], 'text', 'normalized', _ALLF, round_doubles=False)}),
long0 AS (UNPIVOT (SELECT article_id, {', '.join(f'CAST({c} AS DOUBLE) AS "{i}"' for i, c in enumerate(_NAMES))} FROM feats)
          ON {', '.join(f'"{i}"' for i in range(len(_NAMES)))} INTO NAME pos0 VALUE v0),
long1 AS (SELECT article_id, CAST(pos0 AS BIGINT) AS pos0,
                 CASE WHEN CAST(pos0 AS BIGINT) = 3 OR (article_id + CAST(pos0 AS BIGINT)) % 11 = 0 THEN NULL ELSE v0 END AS v
          FROM long0),
st AS (SELECT pos0, avg(v) AS m, count(v) AS nn, count(*) AS n, var_pop(v) AS var FROM long1 GROUP BY pos0 HAVING count(v) > 0),
kept AS (SELECT pos0, m, CASE WHEN sqrt(coalesce(var, 0) * nn / n) > 10 * 2.220446049250313e-16
                              THEN sqrt(coalesce(var, 0) * nn / n) ELSE 1.0 END AS s,
                row_number() OVER (ORDER BY pos0) - 1 AS pos FROM st)"""
ORACLES["impute_mean"] = f"""WITH {_HOLED}
SELECT article_id, pos, {r6('coalesce(v, m)')} AS value FROM long1 JOIN kept USING (pos0)"""
ORACLES["standardize"] = f"""WITH {_HOLED}
SELECT article_id, pos, {r6('(coalesce(v, m) - m) / s')} AS value FROM long1 JOIN kept USING (pos0)"""
ORACLES["merged_standardize"] = ORACLES["standardize"]
ORACLES["label_encode"] = ("SELECT doc_id AS article_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS label "
                           "FROM documents")
ORACLES["hash_split"] = (f"SELECT doc_id AS article_id, CASE WHEN {H('42', q('bucket'), 'doc_id')} % 100 < 80 "
                         f"THEN 'train' ELSE 'test' END AS split FROM documents")
ORACLES["split_data"] = f"""WITH {_AUTHOR_LAB},
r AS (SELECT pair_id, row_number() OVER (ORDER BY {H('42', q('split'), 'pair_id')}, pair_id) - 1 AS rk,
             count(*) OVER () AS n FROM lab_a)
SELECT pair_id, CASE WHEN rk < n - floor(n * 0.2) - floor(n * 0.1) THEN 'train'
                     WHEN rk < n - floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM r"""
ORACLES["stratified_split"] = f"""WITH {_SOURCE_LAB},
r AS (SELECT pair_id, label, row_number() OVER (PARTITION BY label ORDER BY {H('42', q('strat'), 'pair_id')}, pair_id) - 1 AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM lab_s)
SELECT pair_id, label, CASE WHEN rk < floor(ceil(n * 0.3) * 0.5) THEN 'val' WHEN rk < ceil(n * 0.3) THEN 'test'
                            ELSE 'train' END AS split FROM r"""
# the pair model's epochs: accelerated proximal gradient steps as a recursive query over the standardised pair vectors
_MARGIN = "1.0 / (1.0 + exp(-(list_dot_product(z, {w}) + {b})))"
_CLIP = f"least(greatest({_MARGIN.format(w='w', b='b')}, 1e-15), 1 - 1e-15)"
_TRAINED = f"""WITH RECURSIVE {_SOURCE_LAB},
wide AS (SELECT pair_id, id1, id2, label, {_DIFFS}
         FROM lab_s JOIN feats x ON x.article_id = id1 JOIN feats y ON y.article_id = id2),
rk AS (SELECT pair_id, row_number() OVER (PARTITION BY label ORDER BY {H('42', q('strat'), 'pair_id')}, pair_id) - 1 AS rk,
              count(*) OVER (PARTITION BY label) AS n FROM wide),
sp AS (SELECT pair_id, CASE WHEN rk < floor(ceil(n * 0.3) * 0.5) THEN 'val' WHEN rk < ceil(n * 0.3) THEN 'test'
                            ELSE 'train' END AS split FROM rk),
dl AS (SELECT pair_id, label, split, CAST(pos0 AS BIGINT) AS pos, v FROM
       (UNPIVOT wide ON {', '.join(f'"{i}"' for i in range(len(_NAMES)))} INTO NAME pos0 VALUE v) u JOIN sp USING (pair_id)),
fit AS (SELECT pos, avg(v) AS m, CASE WHEN sqrt(var_pop(v)) > 10 * 2.220446049250313e-16 THEN sqrt(var_pop(v)) ELSE 1.0 END AS s
        FROM dl WHERE split = 'train' GROUP BY pos),
zl AS MATERIALIZED (SELECT pair_id, label, split, pos, (v - m) / s AS v FROM dl JOIN fit USING (pos)),
xs AS MATERIALIZED (SELECT pair_id, split, label, CAST(label AS DOUBLE) AS y, list(v ORDER BY pos) AS z FROM zl GROUP BY ALL),
cfg AS (SELECT 1.0 / (0.25 * avg(1.0 + list_dot_product(z, z)) + 0.001 * 0.85) AS step, max(len(z)) AS width FROM xs WHERE split = 'train'),
it(e, w, b, aw, ab, t) AS (
  SELECT 0, [CAST(0 AS DOUBLE) FOR i IN range(width)], CAST(0 AS DOUBLE), [CAST(0 AS DOUBLE) FOR i IN range(width)], CAST(0 AS DOUBLE),
         CAST(1 AS DOUBLE) FROM cfg
  UNION ALL
  SELECT e + 1, nw, nb, [nw[i] + (t - 1) / nt * (nw[i] - w[i]) FOR i IN range(1, len(nw) + 1)], nb + (t - 1) / nt * (nb - b), nt
  FROM (SELECT *, (1 + sqrt(1 + 4 * t * t)) / 2 AS nt, ab - step * gb AS nb,
               [sign(u) * greatest(abs(u) - step * 0.001 * 0.15, 0) FOR u IN
                [aw[i] - step * (g[i] + 0.001 * 0.85 * aw[i]) FOR i IN range(1, len(aw) + 1)]] AS nw
        FROM it, cfg, (SELECT list(g ORDER BY pos) AS g, max(gb) AS gb FROM (
          SELECT pos, avg(err * v) AS g, avg(err) AS gb
          FROM (SELECT pair_id, {_MARGIN.format(w='aw', b='ab')} - y AS err FROM xs, it WHERE split = 'train') r JOIN zl USING (pair_id)
          GROUP BY pos) c) d
        WHERE e < 100) n),
hist AS (SELECT e AS epoch, split, avg(CASE WHEN label = 1 THEN -ln({_CLIP}) ELSE -ln(1.0 - {_CLIP}) END) AS loss,
                avg(CASE WHEN ({_CLIP} > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
         FROM it, xs WHERE e >= 1 AND split IN ('train', 'val') GROUP BY e, split),
best AS (SELECT epoch, loss FROM hist WHERE split = 'val' ORDER BY loss, epoch LIMIT 1)"""
ORACLES["train_history"] = (f"{_TRAINED} SELECT CAST(epoch AS INTEGER) AS epoch, split, {r6('loss')} AS loss, {r6('accuracy')} AS accuracy FROM hist")
ORACLES["best_epoch"] = f"{_TRAINED} SELECT CAST(epoch AS INTEGER) AS best_epoch, {r6('loss')} AS best_val_loss FROM best"
ORACLES["train_pair_model"] = f"""{_TRAINED}
SELECT pair_id, label, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction, {r6('p')} AS prob_1
FROM (SELECT pair_id, label, {_MARGIN.format(w='w', b='b')} AS p FROM xs, it JOIN best ON epoch = e WHERE split = 'test') t"""
ORACLES["score_articles"] = f"""{_TRAINED},
gen AS (SELECT conv_id AS gen_id, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
gf AS ({features_sql('gen', ['gen_id'], 'text', 'normalized', _ALLF, round_doubles=False)}),
gl AS (UNPIVOT (SELECT gen_id, {', '.join(f'CAST({c} AS DOUBLE) AS "{i}"' for i, c in enumerate(_NAMES))} FROM gf)
       ON {', '.join(f'"{i}"' for i in range(len(_NAMES)))} INTO NAME pos0 VALUE v),
al AS (UNPIVOT (SELECT article_id, {', '.join(f'CAST({c} AS DOUBLE) AS "{i}"' for i, c in enumerate(_NAMES))} FROM feats)
       ON {', '.join(f'"{i}"' for i in range(len(_NAMES)))} INTO NAME pos0 VALUE v),
target AS (SELECT article_id, row_number() OVER (ORDER BY {H('42', 'article_id')}, article_id) - 1 AS rank, count(*) OVER () AS n
           FROM articles WHERE is_target),
dr AS (SELECT gen_id, k, {H('42', q('score'), 'gen_id', 'k')} % (SELECT max(n) FROM target) AS rank
       FROM (SELECT gen_id, unnest(range(0, 5)) AS k FROM gen) g),
sd AS (SELECT gen_id, k, sum((abs(gl.v - al.v) - m) / s * w[pos + 1]) + any_value(b) AS margin
       FROM dr JOIN target USING (rank) JOIN gl USING (gen_id) JOIN al ON al.article_id = target.article_id AND al.pos0 = gl.pos0
       JOIN fit ON fit.pos = CAST(gl.pos0 AS BIGINT), it JOIN best ON epoch = e GROUP BY gen_id, k)
SELECT 'g' || gen_id AS gen, {r6('avg(1.0 / (1.0 + exp(-margin)))')} AS prob_same_source, count(*) AS n_pairs,
       CASE WHEN avg(1.0 / (1.0 + exp(-margin))) >= 0.5 THEN 1 ELSE 0 END AS pred_label
FROM sd GROUP BY gen_id"""
_SCORED = f"""WITH {_SOURCE_LAB},
z AS (SELECT pair_id, label, 1.0 - 2.0 * abs(x.avg_word_length - y.avg_word_length)
                              - 5.0 * abs(x.lexical_diversity - y.lexical_diversity)
                              - 0.001 * abs(CAST(x.word_count AS DOUBLE) - CAST(y.word_count AS DOUBLE)) AS z
      FROM lab_s JOIN feats x ON x.article_id = id1 JOIN feats y ON y.article_id = id2),
sc AS (SELECT pair_id, label, 1.0 / (1.0 + exp(-z)) AS prob_1 FROM z),
pr AS (SELECT pair_id, label, prob_1, CASE WHEN prob_1 >= 0.5 THEN 1 ELSE 0 END AS prediction FROM sc)"""
ORACLES["linear_score"] = f"{_SCORED} SELECT pair_id, label, {r6('prob_1')} AS prob_1, prediction FROM pr"
ORACLES["accuracy"] = f"{_SCORED} SELECT {r6('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM pr"
ORACLES["log_loss"] = (f"{_SCORED} SELECT {r6('avg(CASE WHEN label = 1 THEN -ln(least(greatest(prob_1, 1e-15), 1 - 1e-15)) ELSE -ln(1.0 - least(greatest(prob_1, 1e-15), 1 - 1e-15)) END)')} AS log_loss FROM pr")
ORACLES["confusion_matrix"] = f"{_SCORED} SELECT label, prediction, count(*) AS n FROM pr GROUP BY ALL"
ORACLES["classification_report"] = f"""{_SCORED},
cls AS (SELECT label AS c FROM pr UNION SELECT prediction FROM pr),
per AS (SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted,
               count(*) FILTER (WHERE label = c AND prediction = c) AS tp FROM cls, pr GROUP BY c),
pm AS (SELECT CAST(c AS VARCHAR) AS class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM per),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pm)
SELECT class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, CAST(support AS BIGINT) AS support FROM pf
UNION ALL SELECT 'macro avg', {r6('avg(precision)')}, {r6('avg(recall)')}, {r6('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', {r6('sum(precision * support) / sum(support)')}, {r6('sum(recall * support) / sum(support)')},
                 {r6('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'accuracy', NULL, NULL, {r6('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)')}, count(*) FROM pr"""


# ---------------------------------------------------------------- syntax (stand-in annotation)

def _inlist(ws) -> str:
    return ", ".join(q(w) for w in ws)


def annotation_ctes() -> str:
    from penmark.functions.lexicons import FUNCTION_WORDS as FW
    from penmark.operators.standin import CCONJ as STANDIN_CCONJ, SCONJ as STANDIN_SCONJ
    keep = (f"list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), "
            f"lambda s: regexp_matches(regexp_replace(s, '[.!?]+\\z', ''), {q('[^' + SB + ']')}))")
    pos = (f"CASE WHEN lower(text) IN ({_inlist(FW['articles'])}) THEN 'DET' "
           f"WHEN lower(text) IN ({_inlist(FW['prepositions'])}) THEN 'ADP' "
           f"WHEN lower(text) IN ({_inlist(STANDIN_CCONJ)}) THEN 'CCONJ' "
           f"WHEN lower(text) IN ({_inlist(STANDIN_SCONJ)}) THEN 'SCONJ' "
           f"WHEN lower(text) IN ({_inlist(FW['pronouns'])}) THEN 'PRON' "
           f"WHEN lower(text) IN ({_inlist(FW['auxiliary_verbs'])}) THEN 'AUX' "
           f"WHEN regexp_full_match(text, {q(r'\p{Nd}+')}) THEN 'NUM' "
           f"WHEN tok_id > 0 AND regexp_matches(substr(text, 1, 1), {q(r'\p{Lu}')}) THEN 'PROPN' ELSE 'NOUN' END")
    return f"""docs AS (SELECT doc_id, {styled()} AS text FROM documents),
sl AS (SELECT doc_id, {keep} AS l FROM docs),
sents AS (SELECT doc_id AS article_id, CAST(sent_id AS BIGINT) AS sent_id, text FROM
          (SELECT doc_id, unnest(l) AS text, unnest(range(0, len(l))) AS sent_id FROM sl) z),
tl AS (SELECT article_id, sent_id, {words('text')} AS l FROM sents),
tk0 AS (SELECT article_id, sent_id, text, CAST(tok_id AS BIGINT) AS tok_id FROM
          (SELECT article_id, sent_id, unnest(l) AS text, unnest(range(0, len(l))) AS tok_id FROM tl) z),
tk1 AS (SELECT *, {pos} AS pos FROM tk0),
tokens AS (SELECT *, CASE WHEN tok_id = 0 THEN 'ROOT' WHEN pos = 'SCONJ' THEN 'mark' WHEN pos = 'CCONJ' THEN 'cc'
                         WHEN pos = 'DET' THEN 'det' WHEN pos = 'AUX' THEN (CASE WHEN tok_id % 5 = 0 THEN 'auxpass' ELSE 'aux' END)
                         ELSE 'dep' END AS dep,
                  CASE WHEN sent_id % 3 = 0 THEN tok_id // 2 WHEN sent_id % 3 = 1 THEN
                    (CASE WHEN tok_id % 8 <> 0 THEN tok_id - 1 ELSE tok_id // 8 END) ELSE 0 END AS head_id FROM tk1),
mk AS (SELECT article_id, sent_id, tok_id, pos,
              lead(pos) OVER (PARTITION BY article_id, sent_id ORDER BY tok_id) AS nxt,
              lag(pos) OVER (PARTITION BY article_id, sent_id ORDER BY tok_id) AS prv FROM tokens),
chunks AS (SELECT article_id, sent_id, tok_id AS chunk_id FROM mk WHERE pos = 'DET' AND nxt IN ('NOUN', 'PROPN')),
ents AS (SELECT article_id, CAST(sent_id AS VARCHAR) || ':' || CAST(tok_id AS VARCHAR) AS ent_id,
                CASE WHEN tok_id % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS label
         FROM mk WHERE pos = 'PROPN' AND (prv IS NULL OR prv <> 'PROPN'))"""


def _tagfreq(table: str, col: str) -> str:
    return (f"SELECT p.article_id, tag, {r6('n / total')} AS freq FROM "
            f"(SELECT article_id, {col} AS tag, count(*) AS n FROM {table} GROUP BY ALL) p JOIN "
            f"(SELECT article_id, count(*) AS total FROM {table} GROUP BY article_id) t USING (article_id)")


ORACLES["pos_freq"] = f"WITH {annotation_ctes()} {_tagfreq('tokens', 'pos')}"
ORACLES["dep_freq"] = f"WITH {annotation_ctes()} {_tagfreq('tokens', 'dep')}"
ORACLES["ent_freq"] = f"WITH {annotation_ctes()} {_tagfreq('ents', 'label')}"
_RATIOS = """ratios AS (SELECT article_id,
   count(*) FILTER (WHERE pos IN ('VERB', 'AUX')) / greatest(1, count(*) FILTER (WHERE pos IN ('NOUN', 'PROPN'))) AS verb_noun_ratio,
   count(*) FILTER (WHERE pos = 'ADJ') / greatest(1, count(*) FILTER (WHERE pos = 'ADV')) AS adj_adv_ratio,
   count(*) FILTER (WHERE dep IN ('auxpass', 'nsubjpass')) / count(*) AS passive_voice_freq
 FROM tokens GROUP BY article_id)"""
ORACLES["pos_ratios"] = (f"WITH {annotation_ctes()}, {_RATIOS} SELECT article_id, {r6('verb_noun_ratio')} AS verb_noun_ratio, "
                         f"{r6('adj_adv_ratio')} AS adj_adv_ratio FROM ratios")
ORACLES["passive_freq"] = (f"WITH {annotation_ctes()}, {_RATIOS} SELECT article_id, "
                           f"{r6('passive_voice_freq')} AS passive_voice_freq FROM ratios")
_SENTF = f"""walk AS (SELECT article_id, sent_id, tok_id, tok_id AS cur, 0 AS steps FROM tokens WHERE dep <> 'ROOT'
  UNION ALL SELECT w.article_id, w.sent_id, w.tok_id, t.head_id, w.steps + 1 FROM walk w
  JOIN tokens t ON t.article_id = w.article_id AND t.sent_id = w.sent_id AND t.tok_id = w.cur WHERE t.head_id <> t.tok_id),
tokdepth AS (SELECT article_id, sent_id, tok_id, max(steps) + 1 AS d FROM walk GROUP BY ALL),
sdepth AS (SELECT t.article_id, t.sent_id, max(coalesce(d, 0)) AS max_depth FROM tokens t
           LEFT JOIN tokdepth USING (article_id, sent_id, tok_id) GROUP BY ALL),
flags AS (SELECT article_id, sent_id, max(CASE WHEN dep = 'mark' THEN 1 ELSE 0 END) AS has_mark,
                 max(CASE WHEN dep = 'cc' THEN 1 ELSE 0 END) AS has_cc FROM tokens GROUP BY ALL),
nch AS (SELECT article_id, sent_id, count(*) AS n_chunks FROM chunks GROUP BY ALL),
sj AS (SELECT s.article_id, s.sent_id, CASE WHEN ends_with({strip('s.text')}, '?') THEN 1 ELSE 0 END AS is_q,
              has_mark, has_cc, n_chunks, max_depth FROM sents s LEFT JOIN flags USING (article_id, sent_id)
              LEFT JOIN nch USING (article_id, sent_id) LEFT JOIN sdepth USING (article_id, sent_id)),
sentf AS (SELECT article_id, sum(is_q) / greatest(1, count(*)) AS question_freq,
                 sum(coalesce(has_mark, 0)) / greatest(1, count(*)) AS complex_sentence_ratio,
                 sum(coalesce(has_cc, 0)) / greatest(1, count(*)) AS compound_sentence_ratio,
                 sum(coalesce(max_depth, 0)) / greatest(1, count(*)) AS avg_dependency_depth,
                 sum(coalesce(n_chunks, 0)) / count(*) AS avg_sentence_complexity FROM sj GROUP BY article_id)"""
_REC = f"WITH RECURSIVE {annotation_ctes()}, {_SENTF}"
ORACLES["question_freq"] = f"{_REC} SELECT article_id, {r6('question_freq')} AS question_freq FROM sentf"
ORACLES["clause_ratios"] = (f"{_REC} SELECT article_id, {r6('complex_sentence_ratio')} AS complex_sentence_ratio, "
                            f"{r6('compound_sentence_ratio')} AS compound_sentence_ratio FROM sentf")
ORACLES["dep_depth"] = f"{_REC} SELECT article_id, {r6('avg_dependency_depth')} AS avg_dependency_depth FROM sentf"
ORACLES["sentence_complexity"] = f"{_REC} SELECT article_id, {r6('avg_sentence_complexity')} AS avg_sentence_complexity FROM sentf"
ORACLES["syntax_features"] = f"""{_REC}, {_RATIOS}
SELECT d.doc_id AS article_id,
  {', '.join(f"{r6(f'CASE WHEN r.article_id IS NULL THEN 0.0 ELSE coalesce({c}, 0.0) END')} AS {c}" for c in ['verb_noun_ratio', 'adj_adv_ratio', 'passive_voice_freq', 'question_freq', 'complex_sentence_ratio', 'compound_sentence_ratio', 'avg_dependency_depth'])}
FROM docs d LEFT JOIN ratios r ON r.article_id = d.doc_id LEFT JOIN sentf s ON s.article_id = d.doc_id"""


# ---------------------------------------------------------------- cleaning (RE2 runs the original-style regexes)

S_ = "[" + SB + "]"
NS_ = "[^" + SB + "]"
D_ = r"\p{Nd}"


def pages_cte() -> str:
    from penmark.sources.tables import FURNITURE_BLOCK
    base = f"array_to_string(regexp_extract_all(split_part(text, {NL}, 1), {q(NS_ + '+')})[1:5], ' ')"
    did = "CAST(doc_id AS VARCHAR)"
    day = "CAST(doc_id % 28 + 1 AS VARCHAR)"
    lay = "CASE WHEN doc_id % 7 = 6 THEN 'x' ELSE ['a', 'b', 'c'][doc_id % 3 + 1] END"
    return f"""p0 AS (SELECT doc_id, lang, text, {base} AS base, {lay} AS lay FROM documents),
pages AS (SELECT doc_id,
  CASE lay WHEN 'a' THEN 'texts/NYT/' || lang || '/' || {did} || '.pdf'
           WHEN 'b' THEN 'texts/NotNYT/FinancialTimes/' || {did} || '.pdf'
           WHEN 'c' THEN 'texts/NotNYT/WashingtonPost/' || {did} || '.pdf'
           ELSE 'texts/NotNYT/Other/' || {did} || '.pdf' END AS path,
  CASE lay WHEN 'a' THEN base || ' - The New York Times' WHEN 'c' THEN base || ' - The Washington Post' ELSE base END AS title,
  CASE lay WHEN 'a' THEN {q('Section' + chr(10) + 'https://x.example/story/')} || {did} || {q('.html' + chr(10) + 'By Ann Lee and Bo Ray' + chr(10) + 'Summary' + chr(10) + 'January ')}
                         || {day} || {q(', 2025' + chr(10) + 'Updated today' + chr(10) + FURNITURE_BLOCK)} || base || {NL} || text
                         || {q(chr(10) + 'Photo by Cy Doe for The New York Times' + chr(10) + 'Ann Lee reports from Paris.' + chr(10) + 'Bo Ray edits the desk.' + chr(10))}
           WHEN 'b' THEN {q('Front page' + chr(10))} || base || {q(chr(10) + 'cover note' + chr(10) + '1/5/25, 10:02 AM' + chr(10) + 'Ann Lee in Paris' + chr(10) + 'Published JANUARY ')}
                         || {day} || {q(' 2025' + chr(10) + 'https://x.example/b/')} || {did} || {q(' more' + chr(10))} || text
                         || {q(chr(10) + 'Photo © Agency' + chr(10) + 'Copyright The Financial Times Limited 2025. All rights reserved. tail' + chr(10))}
           ELSE {q('Motto' + chr(10) + 'March ')} || {day} || {q(', 2025' + chr(10) + 'Updated later' + chr(10) + 'By Ann Lee' + chr(10))} || base || {NL} || text
                || {q(chr(10) + 'Democracy Dies in Darkness' + chr(10) + 'Bo Ray contributed to this report.' + chr(10))}
                || CASE WHEN doc_id % 5 = 0 THEN {q('What readers are saying' + chr(10) + 'many things' + chr(10))} ELSE '' END END AS page_text
  FROM p0)"""


RX_FURN = (f"(?m)^{D_}{{1,2}}/{D_}{{1,2}}/{D_}{{2}},{S_}+{D_}{{1,2}}:{D_}{{2}}{S_}+[AP]M\\n.*\\n"
           f"(?:https?://{NS_}+|www\\.{NS_}+)\\n{D_}+/{D_}+\\n?")
RX_HTML = r"(?:https?://|www\.)[\S\s]+?\.html\b\n"
RX_DATE = f"[A-Z][a-z]+ {D_}{{1,2}}, {D_}{{4}}(?:, .*?)?\\n"
RX_HA = f"(?m)((.*\\n)*?Listen to this article.*\\n)?(?:.*\\n)*?^By .*\\n(?:.*\\n)*?{RX_DATE}(?:Updated .*\\n)?"
RX_HB = r"(?m)^(?:.*\n)*?^Published.*\n"
RX_HC = f"(?m)(?:.*\\n)*?{RX_DATE}(?:Updated .*\\n)?^By .*\\n"
RX_STAMP = f"{D_}{{1,2}}/{D_}{{1,2}}/{D_}{{2}},{S_}+{D_}{{1,2}}:{D_}{{2}}{S_}+[AP]M\\n"
RX_CAP_A = f"(?m)^.*{S_}for{S_}The{S_}New{S_}York{S_}Times{S_}*$"
RX_CAP_B = "(?m)^.*©.*$\\n?"


def title_rx(title: str) -> str:
    return (f"(array_to_string(list_transform(regexp_extract_all(coalesce({title}, ''), {q(NS_ + '+')}), "
            f"lambda w: '\\Q' || w || '\\E'), {q(S_ + '*')}) || {NL})")


def contribution_sql(t: str) -> str:
    lines = f"string_split({t}, {NL})"
    k = f"list_position(list_transform(list_reverse({lines}), lambda x: regexp_matches(x, {q(NS_)})), true)"
    j = f"(len({lines}) - {k} + 1)"
    line = f"{lines}[{j}]"
    hit = f"({k} IS NOT NULL AND regexp_matches({line}, {q('^.*' + chr(92) + 'bcontributed .*' + chr(92) + '.' + S_ + '*$')}))"
    before = f"(array_to_string({lines}[1:{j} - 1], {NL}) || CASE WHEN {j} > 1 THEN {NL} ELSE '' END)"
    return f"(CASE WHEN {hit} THEN regexp_replace({before}, {q(S_ + '+$')}, '') ELSE {t} END)"


def bios_sql(t: str, names: str) -> str:
    body = strip(t)
    lines = (f"(CASE WHEN {body} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({body}, "
             f"{q(chr(92) + 'r' + chr(92) + 'n|[' + chr(92) + 'n' + chr(92) + 'x0b' + chr(92) + 'x0c' + chr(92) + 'r' + chr(92) + 'x1c-' + chr(92) + 'x1e' + chr(92) + 'x85' + chr(92) + 'x{2028}' + chr(92) + 'x{2029}]')}) END)")
    rev = f"list_reverse({lines})"
    first = f"list_transform({names}, lambda a: coalesce(list_position(list_transform({rev}, lambda l: contains(l, a)), true), 0))"
    all_seen = f"(len({names}) = len(list_distinct({names})) AND NOT coalesce(list_bool_or(list_transform({first}, lambda p: p = 0)), false))"
    hits = f"list_transform({rev}, lambda l: coalesce(list_bool_or(list_transform({names}, lambda a: contains(l, a))), false))"
    latest = (f"(CASE WHEN len({names}) = 0 THEN 0 WHEN {all_seen} THEN list_max({first}) "
              f"WHEN list_position({hits}, true) IS NOT NULL THEN len({lines}) - list_position(list_reverse({hits}), true) + 1 ELSE 0 END)")
    return f"{strip(f'array_to_string({lines}[1:len({lines}) - {latest}], {NL})')}"


def names_sql(author: str) -> str:
    return f"string_split_regex(replace({author}, chr(160), ' '), ', and | and |, ')"


def pubdate_sql(date: str, rule: str) -> str:
    parts = f"regexp_split_to_array(coalesce({date}, ''), '[ ,\\n]+')"
    if rule == "b":
        m = " ".join(f"WHEN {q(x.lower())} THEN '{i + 1}'" for i, x in enumerate(MONTHS_))
        month = f"coalesce(CASE lower({parts}[1]) {m} END, '')"
    else:
        m = " ".join(f"WHEN {q(x)} THEN '{i + 1}'" for i, x in enumerate(MONTHS_))
        month = f"CASE {parts}[1] {m} END" if rule == "a" else f"coalesce(CASE {parts}[1] {m} END, '')"
    return f"({month} || '/' || {parts}[2] || '/' || {parts}[3])"


from penmark.functions.lexicons import MONTHS as MONTHS_  # noqa: E402

_P = f"WITH {pages_cte()}"


def _md5q(expr: str, col: str = "text_md5") -> str:
    return f"{_P} SELECT doc_id, md5({expr}) AS {col} FROM pages"


ORACLES["strip_page_furniture"] = _md5q(f"regexp_replace(page_text, {q(RX_FURN)}, '', 'g')")
ORACLES["strip_html_urls"] = _md5q(f"regexp_replace(page_text, {q(RX_HTML)}, '', 'g')")
ORACLES["header_a"] = _md5q(f"regexp_replace(page_text, {q(RX_HA)}, '', 'g')")
ORACLES["header_b"] = _md5q(f"regexp_replace(page_text, {q(RX_HB)}, '')")
ORACLES["header_c"] = _md5q(f"regexp_replace(page_text, {q(RX_HC)}, '')")
ORACLES["strip_title"] = _md5q(f"regexp_replace(page_text, {title_rx('title')}, '', 'g')")
_G = f"regexp_extract(page_text, '(?m)^.*\\n' || {title_rx('title')} || '((?:.*\\n)*?)' || {q(RX_STAMP)}, 1)"
ORACLES["strip_title_page"] = _md5q(
    f"CASE WHEN {_G} <> '' AND strpos(page_text, {_G}) > 0 THEN substr(page_text, 1, strpos(page_text, {_G}) - 1) "
    f"|| substr(page_text, strpos(page_text, {_G}) + length({_G})) ELSE page_text END")
ORACLES["strip_contribution"] = _md5q(contribution_sql("page_text"))
ORACLES["strip_captions"] = (f"{_P} SELECT doc_id, md5(regexp_replace(page_text, {q(RX_CAP_A)}, '', 'g')) AS a_md5, "
                             f"md5(regexp_replace(page_text, {q(RX_CAP_B)}, '', 'g')) AS b_md5 FROM pages")
from penmark.operators.clean import CORRECTION_A, MOTTO_C, PROMO_C  # noqa: E402

ORACLES["strip_boilerplate"] = (
    f"{_P} SELECT doc_id, md5(regexp_replace(page_text, {q(CORRECTION_A)}, '', 'g')) AS a_md5, "
    f"md5(replace(regexp_replace(page_text, {q(PROMO_C)}, '', 'g'), {q(MOTTO_C)}, '')) AS c_md5 FROM pages")
ORACLES["truncate_tail"] = (
    f"{_P} SELECT doc_id, md5(regexp_replace(page_text, {q('(?s)Copyright The Financial Times Limited 2025' + chr(92) + '. All rights reserved' + chr(92) + '..*')}, '')) AS b_md5, "
    f"md5(regexp_replace(page_text, '(?s)What readers are saying.*', '')) AS c_md5 FROM pages")
_AUTH_A = "regexp_extract(page_text, '(?m)^By (.*)\\n', 1)"
_DATE_A = f"regexp_extract(page_text, {q(RX_DATE)}, 0)"
_DATE_B = "regexp_extract(page_text, 'Published (.*)\\n', 1)"
ORACLES["extract_metadata"] = (
    f"{_P} SELECT doc_id, {_DATE_A} AS date_a, {_AUTH_A} AS author_a, "
    f"regexp_extract(page_text, {q(r'(?:https?://|www\.)[\S\s]+?\.html\b')}, 0) AS url_a, {_DATE_B} AS date_b, "
    f"regexp_extract(page_text, '(.*) in .*\\n', 1) AS author_b FROM pages")
ORACLES["author_split"] = (f"{_P} SELECT doc_id, array_to_string({names_sql(_AUTH_A)}, ';') AS authors, "
                           f"CAST(len({names_sql(_AUTH_A)}) AS BIGINT) AS n_authors FROM pages")
ORACLES["pubdate_parse"] = (f"{_P} SELECT doc_id, {pubdate_sql(_DATE_A, 'a')} AS pub_a, {pubdate_sql(_DATE_B, 'b')} AS pub_b, "
                            f"{pubdate_sql(_DATE_A, 'c')} AS pub_c FROM pages")
ORACLES["strip_author_bios"] = (f"{_P}, pn AS (SELECT doc_id, page_text, {names_sql(_AUTH_A)} AS names FROM pages) "
                                f"SELECT doc_id, md5({bios_sql('page_text', 'names')}) AS text_md5 FROM pn")
_LAYOUT = ("CASE WHEN string_split(path, '/')[2] = 'NYT' THEN 'a' WHEN string_split(path, '/')[3] = 'FinancialTimes' "
           "THEN 'b' WHEN string_split(path, '/')[3] = 'WashingtonPost' THEN 'c' END")
ORACLES["dispatch_clean"] = f"{_P} SELECT doc_id, {_LAYOUT} AS layout FROM pages"
ORACLES["date_coerce"] = (f"WITH {articles_cte()}, d AS (SELECT article_id, CAST(try_strptime(pub_date_raw, '%m/%d/%Y') AS DATE) AS pub_date FROM articles) "
                          f"SELECT article_id, pub_date, (SELECT count(*) FROM d WHERE pub_date IS NULL) AS n_missing_dates FROM d")
ORACLES["path_metadata"] = ("SELECT page_id, string_split(url, '/')[1] AS part0, string_split(url, '/')[3] AS host, "
                            "string_split(url, '/')[4] AS part3 FROM pages")


# ---------------------------------------------------------------- loading / typing / projection

ORACLES["sink_roundtrip"] = (f"WITH {articles_cte()} SELECT source, title, CAST(length(text) AS BIGINT) AS n_chars, "
                             f"md5(text) AS text_md5 FROM articles")
ORACLES["load_typed"] = (f"WITH {articles_cte()} SELECT article_id, source, is_target, "
                         f"CAST(try_strptime(pub_date_raw, '%m/%d/%Y') AS DATE) AS pub_date FROM articles")
_RAW = ("CASE WHEN doc_id % 5 = 0 THEN lang WHEN doc_id % 7 = 0 THEN 'nan' WHEN doc_id % 7 = 1 THEN ' NaN' "
        "ELSE CAST(n_chars AS VARCHAR) END")
ORACLES["numeric_coerce"] = (f"SELECT doc_id, {_RAW} AS raw, CASE WHEN isnan(TRY_CAST({_RAW} AS DOUBLE)) THEN NULL "
                             f"ELSE TRY_CAST({_RAW} AS DOUBLE) END AS value FROM documents")
ORACLES["filter_source"] = f"WITH {articles_cte()} SELECT article_id, title FROM articles WHERE source = 'src0'"
ORACLES["binary_label"] = f"WITH {articles_cte()} SELECT article_id, CASE WHEN is_target THEN 1 ELSE 0 END AS label FROM articles"
ORACLES["concat_pages"] = ("SELECT conv_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM "
                           "(SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id) z")
ORACLES["align_features"] = (f"SELECT doc_id, {', '.join(c for c in LEXICAL_FEATURES)}, 0.0::DOUBLE AS pos_NOUN_freq, "
                             f"0.0::DOUBLE AS word_ngram_0 FROM ({features_sql('documents', ['doc_id'], 'text', 'normalized', ['lexical'])}) z")

# ---------------------------------------------------------------- whole cleaning (C13) and combined features (F8)

def _chain(steps: list[tuple[str, str]], src: str, keep: str) -> str:
    """CTE chain: each step adds one column computed from the previous ones."""
    ctes, prev = [], src
    for i, (name, expr) in enumerate(steps):
        cur = f"{src}_{i}"
        ctes.append(f"{cur} AS (SELECT *, {expr} AS {name} FROM {prev})")
        prev = cur
    return ", ".join(ctes), prev


_URL_A = r"(?:https?://|www\.)[\S\s]+?\.html\b"
_URL_B = r"(?:https?://|www\.)[\S\s]+?.*\b"
_TITLE_PAGE = (lambda t, ti: f"CASE WHEN g6 <> '' AND strpos({t}, g6) > 0 THEN substr({t}, 1, strpos({t}, g6) - 1) "
                             f"|| substr({t}, strpos({t}, g6) + length(g6)) ELSE {t} END")
_LA = [("date", _DATE_A), ("byl", _AUTH_A), ("url0", f"regexp_extract(page_text, {q(_URL_A)}, 0)"),
       ("ttl", "replace(coalesce(title, ''), ' - The New York Times', '')"), ("names", names_sql("byl")),
       ("t1", f"regexp_replace(page_text, {q(RX_FURN)}, '', 'g')"), ("t2", f"regexp_replace(t1, {q(RX_HTML)}, '', 'g')"),
       ("t3", f"regexp_replace(t2, {q(RX_HA)}, '', 'g')"), ("t4", f"regexp_replace(t3, {title_rx('ttl')}, '', 'g')"),
       ("t5", f"regexp_replace(t4, {q(RX_CAP_A)}, '', 'g')"), ("t6", f"regexp_replace(t5, {q(CORRECTION_A)}, '', 'g')"),
       ("t7", bios_sql("t6", "names")), ("tz", contribution_sql("t7")),
       ("pub", pubdate_sql("date", "a")), ("url", strip("url0"))]
_LB = [("date", _DATE_B), ("byl", "regexp_extract(page_text, '(.*) in .*\\n', 1)"),
       ("url0", f"regexp_extract(page_text, {q(_URL_B)}, 0)"), ("ttl", "coalesce(title, '')"), ("names", names_sql("byl")),
       ("g6", f"regexp_extract(page_text, '(?m)^.*\\n' || {title_rx('ttl')} || '((?:.*\\n)*?)' || {q(RX_STAMP)}, 1)"),
       ("t1", _TITLE_PAGE("page_text", "ttl")), ("t2", f"regexp_replace(t1, {q(RX_FURN)}, '', 'g')"),
       ("t3", f"regexp_replace(t2, {q(RX_HTML)}, '', 'g')"), ("t4", f"regexp_replace(t3, {q(RX_HB)}, '')"),
       ("t5", f"regexp_replace(t4, {title_rx('ttl')}, '', 'g')"), ("t6", f"regexp_replace(t5, {q(RX_CAP_B)}, '', 'g')"),
       ("tz", f"regexp_replace(t6, {q('(?s)Copyright The Financial Times Limited 2025' + chr(92) + '. All rights reserved' + chr(92) + '..*')}, '')"),
       ("pub", pubdate_sql("date", "b")), ("url", strip("url0"))]
_LC = [("date", _DATE_A), ("byl", _AUTH_A), ("ttl", "replace(coalesce(title, ''), ' - The Washington Post', '')"),
       ("names", names_sql("byl")),
       ("t1", f"regexp_replace(page_text, {q(RX_FURN)}, '', 'g')"), ("t2", f"regexp_replace(t1, {q(RX_HC)}, '')"),
       ("t3", f"regexp_replace(t2, {title_rx('ttl')}, '', 'g')"),
       ("t4", "regexp_replace(t3, '(?s)What readers are saying.*', '')"),
       ("t5", f"regexp_replace(t4, {q(PROMO_C)}, '', 'g')"), ("t6", contribution_sql("t5")),
       ("tz", f"replace(t6, {q(MOTTO_C)}, '')"), ("pub", pubdate_sql("date", "c")), ("url", "'NA'")]


def _layout_sql(tag: str, steps) -> tuple[str, str]:
    base = f"la{tag} AS (SELECT doc_id, path, title, page_text FROM pages WHERE ({_LAYOUT}) = '{tag}')"
    chain, last = _chain(steps, f"la{tag}", "")
    sel = (f"SELECT doc_id, '{tag}' AS layout, array_to_string(names, ';') AS author, "
           f"string_split(path, '/')[2] AS source, CASE WHEN string_split(path, '/')[2] = 'NYT' THEN '1' ELSE '0' END AS is_target, "
           f"string_split(path, '/')[3] AS genre, pub AS pub_date, ttl AS title, md5({strip('tz')}) AS text_md5, url FROM {last}")
    return f"{base}, {chain}", sel


_ca = [_layout_sql(t, s) for t, s in (("a", _LA), ("b", _LB), ("c", _LC))]
_REJECTS = (f"SELECT doc_id, NULL, NULL, string_split(path, '/')[2], '0', string_split(path, '/')[3], NULL, NULL, NULL, NULL "
            f"FROM pages WHERE ({_LAYOUT}) IS NULL")
ORACLES["clean_articles"] = (f"{_P}, " + ", ".join(c for c, _ in _ca) + " "
                             + " UNION ALL ".join([*(s for _, s in _ca), _REJECTS]))


# ---------------------------------------------------------------- the wide vector by registry

_SYN7 = ['verb_noun_ratio', 'adj_adv_ratio', 'passive_voice_freq', 'question_freq', 'complex_sentence_ratio',
         'compound_sentence_ratio', 'avg_dependency_depth']


def _values(names: list[str]) -> str:
    return f"(VALUES {', '.join(f'({i}, {q(n)})' for i, n in enumerate(names))}) t(io, name)"


def _freqs(table: str, col: str) -> str:
    return (f"SELECT p.article_id, tag, n / total AS v FROM (SELECT article_id, {col} AS tag, count(*) AS n FROM {table} GROUP BY ALL) p "
            f"JOIN (SELECT article_id, count(*) AS total FROM {table} GROUP BY article_id) t USING (article_id)")


def wide_ctes(basic_too: bool) -> str:
    """reg (pos, family, name, key) and cell (article_id, family, key, v)."""
    tags = [("pos", "posf"), ("dep", "depf"), ("ent", "entf")]
    reg = [f"SELECT 1 AS fo, io, 'syntax' AS family, name, name AS key FROM {_values(_SYN7)}"]
    reg += [f"SELECT {i + 2}, row_number() OVER (ORDER BY tag), '{f}', '{f}_' || tag || '_freq', tag FROM (SELECT DISTINCT tag FROM {t}) t"
            for i, (f, t) in enumerate(tags)]
    reg.append("SELECT 5, row_number() OVER (ORDER BY term), 'word_ngram', term, term FROM vocab")
    cell = [f"SELECT article_id, 'syntax' AS family, '{c}' AS key, {c} AS v FROM syn" for c in _SYN7]
    cell += [f"SELECT article_id, '{f}', tag, v FROM {t}" for f, t in tags]
    cell.append("SELECT article_id, 'word_ngram', term, v FROM tfw")
    basic_cte = ""
    if basic_too:
        reg.append(f"SELECT 0, io, 'basic', name, name FROM {_values(_NAMES)}")
        cell += [f"SELECT article_id, 'basic', '{c}', CAST({c} AS DOUBLE) FROM bf WHERE {c} IS NOT NULL" for c in _NAMES]
        basic_cte = f"bf AS (SELECT doc_id AS article_id, * EXCLUDE (doc_id) FROM ({features_sql(styled_src(), ['doc_id'], 'text', 'normalized', _ALLF, round_doubles=False)}) z),"
    return f"""{annotation_ctes()}, {_SENTF}, {_RATIOS}, {basic_cte}
syn AS (SELECT d.doc_id AS article_id,
  {', '.join(f"CAST(CASE WHEN r.article_id IS NULL THEN 0.0 ELSE coalesce({c}, 0.0) END AS DOUBLE) AS {c}" for c in _SYN7)}
  FROM docs d LEFT JOIN ratios r ON r.article_id = d.doc_id LEFT JOIN sentf s ON s.article_id = d.doc_id),
posf AS ({_freqs('tokens', 'pos')}), depf AS ({_freqs('tokens', 'dep')}), entf AS ({_freqs('ents', 'label')}),
ndocs AS (SELECT doc_id AS article_id, {norm('text')} AS text FROM docs),
{vocab_cte('ndocs', 'article_id')},
w AS (SELECT article_id, term, (1 + ln(c)) * idf AS w FROM tf JOIN vocab USING (term)),
nrm AS (SELECT article_id, sqrt(sum(w * w)) AS n FROM w GROUP BY article_id),
tfw AS (SELECT article_id, term, w / n AS v FROM w JOIN nrm USING (article_id)),
reg AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY fo, io) - 1 AS BIGINT) AS pos, family, name, key FROM ({' UNION ALL '.join(reg)}) r),
cell AS MATERIALIZED ({' UNION ALL '.join(cell)})"""


ORACLES["feature_registry"] = f"WITH RECURSIVE {wide_ctes(True)} SELECT pos, family, name FROM reg"
ORACLES["all_features"] = (f"WITH RECURSIVE {wide_ctes(True)} SELECT article_id, pos, {r6('v')} AS value "
                           f"FROM cell JOIN reg USING (family, key)")
ORACLES["advanced_features"] = f"""WITH RECURSIVE {wide_ctes(False)},
lng AS (SELECT d.doc_id AS article_id, reg.pos, CASE WHEN reg.family = 'word_ngram' THEN coalesce(v, 0.0) ELSE v END AS v
        FROM docs d CROSS JOIN reg LEFT JOIN cell ON cell.article_id = d.doc_id AND cell.family = reg.family AND cell.key = reg.key),
st2 AS (SELECT pos, count(*) AS n, count(v) AS nn, avg(v) AS m, var_pop(v) AS var FROM lng GROUP BY pos HAVING count(v) > 0),
sc AS (SELECT pos, m, CASE WHEN sqrt(coalesce(var, 0) * nn / n) > 10 * 2.220446049250313e-16
                         THEN sqrt(coalesce(var, 0) * nn / n) ELSE 1.0 END AS s FROM st2)
SELECT article_id, pos, {r6('(coalesce(v, m) - m) / s')} AS value FROM lng JOIN sc USING (pos)"""


# ---------------------------------------------------------------- Y12 and U1: wide tag frequencies

def _tag_columns(col: str, tags: list[str], prefix: str, suffix: str) -> str:
    n = "count(*) FILTER (WHERE {} = {})"
    return ", ".join(f"{r6(f'CASE WHEN {n.format(col, q(t))} > 0 THEN {n.format(col, q(t))} / count(*) END')} AS {prefix}{t}{suffix}"
                     for t in tags)


from penmark.operators.standin import DEP as STANDIN_DEP, ENT as STANDIN_ENT, POS as STANDIN_POS  # noqa: E402

ORACLES["article_tags"] = f"""{_REC},
tw AS (SELECT article_id, {_tag_columns('pos', STANDIN_POS, 'pos_freq_', '')}, {_tag_columns('dep', STANDIN_DEP, 'dep_freq_', '')}
       FROM tokens GROUP BY article_id),
ew AS (SELECT article_id, {_tag_columns('label', STANDIN_ENT, 'ent_freq_', '')} FROM ents GROUP BY article_id)
SELECT doc_id AS article_id, tw.* EXCLUDE (article_id), ew.* EXCLUDE (article_id),
       {r6('coalesce(avg_sentence_complexity, 0.0)')} AS avg_sentence_complexity
FROM docs LEFT JOIN tw ON tw.article_id = doc_id LEFT JOIN ew ON ew.article_id = doc_id
     LEFT JOIN sentf ON sentf.article_id = doc_id"""
_TAG_SQL = ORACLES["article_tags"]
ORACLES["process_articles"] = f"""SELECT l.article_id, l.* EXCLUDE (article_id, unique_word_ratio), t.* EXCLUDE (article_id)
FROM (SELECT doc_id AS article_id, * EXCLUDE (doc_id) FROM ({features_sql(styled_src(), ['doc_id'], 'text', 'raw', ['lexical'])}) f) l
LEFT JOIN ({_TAG_SQL}) t ON t.article_id = l.article_id"""
ORACLES["union_features"] = f"""WITH {annotation_ctes()}
SELECT article_id, {_tag_columns('pos', STANDIN_POS, 'pos_', '_freq')} FROM tokens WHERE article_id % 2 = 0 GROUP BY article_id
UNION ALL BY NAME
SELECT article_id, {_tag_columns('pos', STANDIN_POS[:-1], 'pos_', '_freq')} FROM tokens WHERE article_id % 2 = 1 GROUP BY article_id"""
ORACLES["join_features"] = f"""WITH RECURSIVE {annotation_ctes()}, {_SENTF}, {_RATIOS}, {articles_cte()},
b AS ({features_sql(styled_src(), ['doc_id'], 'text', 'normalized', _ALLF)}),
s AS (SELECT d.doc_id,
  {', '.join(f"{r6(f'CASE WHEN r.article_id IS NULL THEN 0.0 ELSE coalesce({c}, 0.0) END')} AS {c}" for c in _SYN7)}
  FROM docs d LEFT JOIN ratios r ON r.article_id = d.doc_id LEFT JOIN sentf sf ON sf.article_id = d.doc_id),
tw AS (SELECT article_id, {_tag_columns('pos', STANDIN_POS, 'pos_freq_', '')}, {_tag_columns('dep', STANDIN_DEP, 'dep_freq_', '')}
       FROM tokens GROUP BY article_id),
ew AS (SELECT article_id, {_tag_columns('label', STANDIN_ENT, 'ent_freq_', '')} FROM ents GROUP BY article_id)
SELECT a.article_id, a.source, a.genre, a.title, b.* EXCLUDE (doc_id), s.* EXCLUDE (doc_id), tw.* EXCLUDE (article_id),
       ew.* EXCLUDE (article_id), {r6('coalesce(avg_sentence_complexity, 0.0)')} AS avg_sentence_complexity
FROM articles a JOIN b ON b.doc_id = a.article_id JOIN s ON s.doc_id = a.article_id
     LEFT JOIN tw ON tw.article_id = a.article_id LEFT JOIN ew ON ew.article_id = a.article_id
     LEFT JOIN sentf ON sentf.article_id = a.article_id"""
ORACLES["feature_projection"] = features_sql("articles_src", ["article_id"], "text", "normalized", ["lexical", "readability"]).replace(
    "articles_src", "(SELECT doc_id AS article_id, text FROM documents)")
