"""Article cleaning (C1-C13, T10-T14, P1, P10) as column expressions.

Input: page text already extracted (PDF decoding is outside Spark's scope),
the document title and the file path.  Three page layouts are supported,
``a``, ``b`` and ``c``; their literal markers are configuration below.

Rules that cut a prefix or a suffix of the text by whole lines (headers,
author bios, contribution line) run over the line array: a lazily repeated
group of lines in a Java regex recurses once per line and overflows the stack
on long texts, while ``split`` + ``aggregate`` + ``slice`` is linear.  The
flags each fold consumes are computed first with ``transform``; the fold's
lambda only reads its own variables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penmark.functions import text as T
from penmark.functions.lexicons import MONTHS
from penmark.operators import clean_rules
from penmark.operators.clean_rules import Rule

SP = T.SPACE
NSP = T.NONSPACE

# --- FIXED VALUES: layout markers and boilerplate (regular expressions) ---
TITLE_SUFFIX = {"a": " - The New York Times", "b": None, "c": " - The Washington Post"}
CAPTION_A = (r"(?md)^[^\n]*" + SP + "for" + SP + "The" + SP + "New" + SP + "York" + SP + "Times" + SP + "*$")
CAPTION_B = "(?md)^[^\n]*©[^\n]*$\n?"
BYLINE = r"(?md)^By ([^\n]*)\n"
# what stands before the last ' in ' of the first ended line that holds one; tried at line starts only and for ended
# lines only, so the pass is linear in the longest line
BYLINE_B = r"(?md)^(?=[^\n]*+\n)([^\n]*) in "
CORRECTION_A = (r"When we learn of a mistake, we acknowledge it with a correction. If you spot an error, "
                r"please let us know at\nnytnews@nytimes.com. Learn more(\n)*")
COPYRIGHT_B = r"(?s)Copyright The Financial Times Limited 2025\. All rights reserved\..*"
READERS_C = r"(?s)What readers are saying.*"
PROMO_C = ("Trump presidency\nFollow live updates on the Trump administration. We’re tracking Trump’s\n"
           "progress on campaign promises and legal challenges to his executive orders and\nactions.\n")
MOTTO_C = "Democracy Dies in Darkness\n"
TARGET_SOURCE = "NYT"
LAYOUT_BY_SOURCE = {"FinancialTimes": "b", "WashingtonPost": "c"}

DIGIT = r"\p{Nd}"
DATE_A = rf"[A-Z][a-z]+ {DIGIT}{{1,2}}, {DIGIT}{{4}}(?:, [^\n]*?)?\n"
DATE_LINE = rf"^[A-Z][a-z]+ {DIGIT}{{1,2}}, {DIGIT}{{4}}(?:, [^\n]*)?$"
STAMP = rf"{DIGIT}{{1,2}}/{DIGIT}{{1,2}}/{DIGIT}{{2}},{SP}+{DIGIT}{{1,2}}:{DIGIT}{{2}}{SP}+[AP]M\n"
FURNITURE = rf"(?md)^{STAMP}[^\n]*\n(?:https?://{NSP}+|www\.{NSP}+)\n{DIGIT}+/{DIGIT}+\n?"
HTML_URL = r"(?:https?://|www\.)[\s\S]+?\.html\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------- captures

def capture_date(text, layout: str) -> Column:
    if layout == "b":
        return F.regexp_extract(_c(text), r"Published ([^\n]*)\n", 1)
    return F.regexp_extract(_c(text), DATE_A, 0)


def capture_author(text, layout: str) -> Column:
    if layout == "b":
        return F.regexp_extract(_c(text), BYLINE_B, 1)
    return F.regexp_extract(_c(text), BYLINE, 1)


def capture_url(text, layout: str) -> Column:
    if layout == "a":
        # the first URL start alone decides: if no '.html' follows it, none follows a later one
        # ('.' with (?s) is one look per character, the union [\s\S] several)
        rest = F.regexp_extract(_c(text), r"(?s)(?:https?://|www\.).*", 0)
        return F.regexp_extract(rest, r"(?s)\A(?:https?://|www\.).+?\.html\b", 0)
    if layout == "b":
        return F.regexp_extract(_c(text), r"(?:https?://|www\.)[\s\S]+?[^\n]*\b", 0)
    return F.lit("NA")


# ------------------------------------------------------------- removals

def strip_page_furniture(text) -> Column:
    """The 4-line block a printed page starts with."""
    return F.regexp_replace(_c(text), FURNITURE, "")


def strip_html_urls(text) -> Column:
    """A URL running (possibly over lines) to '.html' and a newline.
    Matched only up to the last '.html' line end, so every attempt succeeds and
    the pass is linear; what follows holds no match."""
    tail = F.substring_index(_c(text), ".html\n", -1)
    head = F.left(_c(text), F.length(_c(text)) - F.length(tail))
    return F.concat(F.regexp_replace(head, HTML_URL, ""), tail)


def _lines(text) -> Column:
    return F.split(_c(text), "\n", -1)


def _terminated(lines: Column, shift: int = 0) -> Column:
    """Per line: is it followed by a '\\n' (i.e. not the final element)?
    Optionally shifted: position i holds the flag of line i + shift."""
    n = F.size(lines)
    flags = F.concat(F.array_repeat(F.lit(True), F.greatest(n - 1, F.lit(0))), F.array(F.lit(False)))
    if shift:
        flags = F.concat(F.slice(flags, shift + 1, F.greatest(n, F.lit(1))), F.array_repeat(F.lit(False), shift))
    return flags


def _drop_first(lines: Column, k: Column) -> Column:
    """Lines after the first k, joined."""
    return F.array_join(F.slice(lines, k + 1, F.greatest(F.size(lines) - k, F.lit(0))), "\n")


def header_a(text) -> Column:
    """Repeatedly drop everything through a date line that follows a
    'By ' line, plus an 'Updated ' line right after it."""
    lines = _lines(text)
    n = F.size(lines)
    idx = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    flags = F.arrays_zip(
        idx.alias("i"),
        F.transform(lines, lambda ln: ln.startswith("By ")).alias("by"),
        F.transform(lines, lambda ln: ln.rlike(DATE_LINE)).alias("dt"),
        F.transform(lines, lambda ln: ln.startswith("Updated ")).alias("up"),
        _terminated(lines).alias("term"))   # only '\n'-terminated lines count
    init = F.struct(F.lit(0).alias("state"), F.lit(0).alias("cut"), F.lit(False).alias("pend"))

    def step(acc, f):
        take_up = acc["pend"] & f["up"] & f["term"]
        after_date = f["term"] & (acc["state"] == 1) & f["dt"] & ~take_up
        new_state = (F.when(after_date, F.lit(0))
                     .when(f["term"] & (acc["state"] == 0) & f["by"] & ~take_up, F.lit(1))
                     .otherwise(acc["state"]))
        new_cut = F.when(take_up | after_date, f["i"] + 1).otherwise(acc["cut"])
        return F.struct(new_state.alias("state"), new_cut.cast("int").alias("cut"), after_date.alias("pend"))

    cut = F.aggregate(flags, init, step)["cut"]
    return _drop_first(lines, cut)


def header_b(text) -> Column:
    """C4: drop everything through the first line starting 'Published'."""
    return clean_rules.cut_through(_c(text), "Published")


def header_c(text) -> Column:
    """Drop everything through the first 'date [Updated] By' block."""
    lines = _lines(text)
    n = F.size(lines)
    by = F.transform(lines, lambda ln: ln.startswith("By "))
    dt = F.transform(lines, lambda ln: ln.rlike(DATE_LINE))
    up = F.transform(lines, lambda ln: ln.startswith("Updated "))
    # shifted copies: flag of line i+1 / i+2 at position i
    by1 = F.concat(F.slice(by, 2, F.greatest(n, F.lit(1))), F.array(F.lit(False)))
    by2 = F.concat(F.slice(by, 3, F.greatest(n, F.lit(1))), F.array(F.lit(False), F.lit(False)))
    up1 = F.concat(F.slice(up, 2, F.greatest(n, F.lit(1))), F.array(F.lit(False)))
    z = F.arrays_zip(dt.alias("dt"), by1.alias("b1"), by2.alias("b2"), up1.alias("u1"),
                     _terminated(lines, 1).alias("t1"), _terminated(lines, 2).alias("t2"))
    # a block must be '\n'-terminated: its last line is not the final element
    span = F.transform(z, lambda r: F.when(r["dt"] & r["u1"] & r["b2"] & r["t2"], F.lit(3))
                       .when(r["dt"] & r["b1"] & r["t1"], F.lit(2)).otherwise(F.lit(0)))
    first = F.array_position(F.transform(span, lambda s: s > 0), True)
    size = F.element_at(span, F.greatest(first, F.lit(1)).cast("int"))
    return F.when(first > 0, _drop_first(lines, (first + size - 1).cast("int"))).otherwise(_c(text))


def title_pattern(title) -> Column:
    """Title words, regex-quoted, joined by optional whitespace, then '\\n'."""
    words = F.regexp_extract_all(F.coalesce(_c(title), F.lit("")), F.lit(f"{NSP}+"), F.lit(0))
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")),
                                                   F.lit(r"\E")))
    return F.concat(F.array_join(quoted, f"{SP}*"), F.lit("\n"))


def strip_title(text, title) -> Column:
    """Every occurrence of the (whitespace-flexible) title line."""
    return F.regexp_replace(_c(text), title_pattern(title), F.lit(""))


def strip_title_page(text, title) -> Column:
    """The lines between the title and the first page timestamp, removed
    once as literal text (the reference used them as a pattern)."""
    t = _c(text)
    pat = F.concat(F.lit(r"(?md)^[^\n]*\n"), title_pattern(title), F.lit(r"([\s\S]*?)^"), F.lit(STAMP))
    g = F.call_function("regexp_extract", t, pat, F.lit(1))  # pattern is a column
    pos = F.instr(t, g)
    removed = F.concat(t.substr(F.lit(1), pos - 1), t.substr(pos + F.length(g), F.length(t) + 1))
    return F.when((g != "") & (pos > 0), removed).otherwise(t)


def strip_captions(text, layout: str) -> Column:
    """Photo credit lines (a) / lines holding a copyright sign (b)."""
    if layout == "a":
        return F.regexp_replace(_c(text), CAPTION_A, "")
    if layout == "b":
        return F.regexp_replace(_c(text), CAPTION_B, "")
    return _c(text)


def strip_boilerplate(text, layout: str) -> Column:
    """Fixed notices."""
    t = _c(text)
    if layout == "a":
        return F.regexp_replace(t, CORRECTION_A, "")
    if layout == "c":
        return F.replace(F.regexp_replace(t, PROMO_C.replace(".", r"."), ""), F.lit(MOTTO_C), F.lit(""))
    return t


def truncate_tail(text, layout: str) -> Column:
    """Everything from the closing marker on."""
    if layout == "b":
        return F.regexp_replace(_c(text), COPYRIGHT_B, "")
    if layout == "c":
        return F.regexp_replace(_c(text), READERS_C, "")
    return _c(text)


def split_authors(author) -> Column:
    """T10 on a captured byline."""
    return T.author_split(F.coalesce(_c(author), F.lit("")))


def strip_author_bios(text, names) -> Column:
    """C11: walk lines from the bottom until every name was seen; cut at the
    topmost line (within that walk) holding any name.  An empty name is in
    every line, as in the reference.  ``names`` should be a column (it is
    read inside lambdas)."""
    body = T.strip_ws(_c(text))
    lines = F.when(body == "", F.array().cast("array<string>")).otherwise(
        F.split(body, "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", -1))
    n = F.size(lines)
    rev = F.reverse(lines)
    nm = _c(names)
    # per name: first position from the bottom (1-based) holding it, 0 if none
    first = F.transform(nm, lambda a: F.array_position(F.transform(rev, lambda ln: F.instr(ln, a) > 0), True))
    all_seen = (F.size(nm) == F.size(F.array_distinct(nm))) & ~F.exists(first, lambda p: p == 0)
    hits = F.transform(rev, lambda ln: F.exists(nm, lambda a: F.instr(ln, a) > 0))
    last_hit = F.size(lines) - F.array_position(F.reverse(hits), True) + 1
    latest = (F.when(F.size(nm) == 0, F.lit(0))
              .when(all_seen, F.array_max(first))
              .when(F.array_position(hits, True) > 0, last_hit).otherwise(F.lit(0)))
    kept = F.slice(lines, 1, F.greatest(n - latest, F.lit(0)).cast("int"))
    return T.strip_ws(F.array_join(kept, "\n"))


def strip_contribution(text) -> Column:
    """Drop the last non-blank line when it reads '... contributed ... .'
    (and only whitespace follows), then trailing whitespace."""
    lines = _lines(text)
    n = F.size(lines)
    blank = F.transform(F.reverse(lines), lambda ln: ~ln.rlike(NSP))
    k = F.array_position(blank, False)      # 1-based from the bottom
    j = n - k + 1                            # 1-based index of the last non-blank line
    line = F.element_at(lines, F.greatest(j, F.lit(1)).cast("int"))
    hit = (k > 0) & line.rlike(rf"^[^\n]*(?<![\p{{L}}\p{{N}}_])contributed [^\n]*\.{SP}*$")
    before = F.array_join(F.slice(lines, 1, F.greatest(j - 1, F.lit(0)).cast("int")), "\n")
    cut = F.regexp_replace(F.concat(before, F.when(j > 1, F.lit("\n")).otherwise(F.lit(""))), f"{SP}+\\z", "")
    return F.when(hit, cut).otherwise(_c(text))


# ------------------------------------------------------------- dates

def pubdate(date, layout: str) -> Column:
    """T11: 'Month D, YYYY...' -> 'M/D/YYYY'.  Layout a needs a known month
    (else NULL); b looks the month up lower-cased and c as is, an unknown
    month giving ''.  A missing day or year gives NULL."""
    parts = F.split(F.coalesce(_c(date), F.lit("")), "[ ,\n]+")
    if layout == "b":
        m = F.create_map(*[x for i, name in enumerate(MONTHS) for x in (F.lit(name.lower()), F.lit(str(i + 1)))])
        month = F.coalesce(F.element_at(m, F.lower(F.element_at(parts, 1))), F.lit(""))
    else:
        m = F.create_map(*[x for i, name in enumerate(MONTHS) for x in (F.lit(name), F.lit(str(i + 1)))])
        month = F.element_at(m, F.element_at(parts, 1))
        if layout == "c":
            month = F.coalesce(month, F.lit(""))
    return F.concat(month, F.lit("/"), F.try_element_at(parts, F.lit(2)), F.lit("/"),
                    F.try_element_at(parts, F.lit(3)))


def coerce_date(s) -> Column:
    """P1: 'M/D/YYYY' -> DATE, unparseable -> NULL."""
    return F.try_to_date(_c(s), "M/d/yyyy")


# ------------------------------------------------------------- whole layouts

for _name, _rule in {
        "page_furniture": strip_page_furniture, "html_urls": strip_html_urls, "header_by_date": header_a, "header_date_by": header_c,
        "contribution": strip_contribution, "title": lambda t: strip_title(t, "__title"), "title_page": lambda t: strip_title_page(t, "__title"),
        "author_bios": lambda t: strip_author_bios(t, "__names"), "first_html_url": lambda t: T.strip_ws(capture_url(t, "a")),
        "first_url": lambda t: T.strip_ws(capture_url(t, "b"))}.items():
    clean_rules.built_in(_name)(_rule)

# --- FIXED VALUES: the three layouts, steps in order ---
RULES = clean_rules.checked([Rule(*r) for r in [
    ("a", "source", 0, "folder", TARGET_SOURCE),
    ("a", "date", 0, "extract", DATE_A),
    ("a", "byline", 0, "extract_group", BYLINE),
    ("a", "url", 0, "built_in", "first_html_url"),
    ("a", "title", 0, "input", "title_in|" + TITLE_SUFFIX["a"]),
    ("a", "text", 1, "built_in", "page_furniture"),
    ("a", "text", 2, "built_in", "html_urls"),
    ("a", "text", 3, "built_in", "header_by_date"),
    ("a", "text", 4, "built_in", "title"),
    ("a", "text", 5, "remove", CAPTION_A),
    ("a", "text", 6, "remove", CORRECTION_A),
    ("a", "text", 7, "built_in", "author_bios"),
    ("a", "text", 8, "built_in", "contribution"),
    *[("b", "genre", 0, "folder", g) for g, layout in LAYOUT_BY_SOURCE.items() if layout == "b"],
    ("b", "date", 0, "extract_group", r"Published ([^\n]*)\n"),
    ("b", "byline", 0, "extract_group", BYLINE_B),
    ("b", "url", 0, "built_in", "first_url"),
    ("b", "title", 0, "input", "title_in"),
    ("b", "text", 1, "built_in", "title_page"),
    ("b", "text", 2, "built_in", "page_furniture"),
    ("b", "text", 3, "built_in", "html_urls"),
    ("b", "text", 4, "cut_through", "Published"),
    ("b", "text", 5, "built_in", "title"),
    ("b", "text", 6, "remove", CAPTION_B),
    ("b", "text", 7, "remove", COPYRIGHT_B),
    *[("c", "genre", 0, "folder", g) for g, layout in LAYOUT_BY_SOURCE.items() if layout == "c"],
    ("c", "date", 0, "extract", DATE_A),
    ("c", "byline", 0, "extract_group", BYLINE),
    ("c", "url", 0, "constant", "NA"),
    ("c", "title", 0, "input", "title_in|" + TITLE_SUFFIX["c"]),
    ("c", "text", 1, "built_in", "page_furniture"),
    ("c", "text", 2, "built_in", "header_date_by"),
    ("c", "text", 3, "built_in", "title"),
    ("c", "text", 4, "remove", READERS_C),
    ("c", "text", 5, "remove", PROMO_C),
    ("c", "text", 6, "built_in", "contribution"),
    ("c", "text", 7, "remove_text", MOTTO_C),
]])


def clean_pages(df, layout_col: str = "layout", text: str = "page_text", title: str = "title",
                layouts: list[str] | None = None, rules: list[Rule] = RULES):
    """C13 in ONE pass over the input: every stage is a column
    ``CASE layout WHEN 'a' THEN step_a WHEN 'b' THEN step_b ...``; CASE runs
    only the taken branch, so a row pays for its own layout's steps and the
    text is scanned once whatever the layout mix.  Metadata is captured from
    the uncut text first; then the steps run in each layout's own order.
    Adds ``author, pub_date, clean_title, clean_text, url``."""
    layouts = layouts or clean_rules.layouts(rules)
    specs = {lay: clean_rules.steps(rules, lay) for lay in layouts}
    lay = F.col(layout_col)

    def case(builders):
        expr = None
        for name, b in builders:
            expr = (F.when(lay == name, b()) if expr is None else expr.when(lay == name, b()))
        return expr

    x = df.withColumn("title_in", F.col(title))
    for cap, target in (("__date", "date"), ("__by", "byline"), ("__url", "url"), ("__title", "title")):
        x = x.withColumn(cap, case([(L, lambda L=L: clean_rules.capture(rules, L, target, text)) for L in layouts]))
    x = x.withColumn("__names", split_authors("__by"))
    prev = text
    for k in range(max(map(len, specs.values()))):
        cur = f"__t{k + 1}"
        parts = []
        for L in layouts:
            steps = specs[L]
            parts.append((L, (lambda f=steps[k], p=prev: f(p)) if k < len(steps) else (lambda p=prev: F.col(p))))
        x = x.withColumn(cur, case(parts))
        prev = cur
    pub = case([(L, lambda L=L: pubdate("__date", L)) for L in layouts])
    work = [c for c in x.columns if c.startswith("__")] + ["title_in"]
    return (x.withColumn("author", F.array_join("__names", ";"))
             .withColumn("pub_date", pub)
             .withColumn("clean_title", F.col("__title"))
             .withColumn("clean_text", T.strip_ws(F.col(prev)))
             .withColumn("url", F.col("__url"))
             .drop(*work))


def clean_layout(df, layout: str, text: str = "page_text", title: str = "title", rules: list[Rule] = RULES):
    """C13 for input known to be of one layout."""
    return clean_pages(df.withColumn("__layout", F.lit(layout)), "__layout", text, title, [layout], rules).drop("__layout")


def layout_of(path, rules: list[Rule] = RULES) -> Column:
    """P10: 'texts/<Source>/<Genre>/file': the rules name the layout by the source folder,
    otherwise by the genre folder; unknown -> NULL."""
    return clean_rules.layout_of(rules, T.path_part(path, 1), T.path_part(path, 2))


def clean_all(df, path: str = "path", text: str = "page_text", title: str = "title", rules: list[Rule] = RULES):
    """C13 + P10 in one pass over all rows: dispatch by path and clean.  A row of
    an unknown layout stays as a reject: ``layout`` and all cleaned columns are NULL."""
    x = clean_pages(df.withColumn("layout", layout_of(path, rules)), "layout", text, title, rules=rules)
    known = F.col("layout").isNotNull()
    cleaned = {c: F.when(known, F.col(c)) for c in ("author", "pub_date", "clean_title", "clean_text", "url")}
    return x.withColumns(cleaned).select(
        "*", T.path_part(path, 1).alias("source"), T.path_part(path, 2).alias("genre"),
        F.when(T.path_part(path, 1) == TARGET_SOURCE, F.lit("1")).otherwise(F.lit("0")).alias("is_target"))


def clean_articles(df, path: str = "path", text: str = "page_text", title: str = "title", rules: list[Rule] = RULES):
    """C13 + P10 as two frames: cleaned rows, and the rejects."""
    x = clean_all(df, path, text, title, rules)
    return x.where(F.col("layout").isNotNull()), x.where(F.col("layout").isNull())
