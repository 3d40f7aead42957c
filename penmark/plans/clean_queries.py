"""Registered queries for article cleaning (C-series, T10-T14, P1, P10, S4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.functions import text as T
from penmark.operators import clean
from penmark.plans.registry import query
from penmark.sources import tables


def _pages(spark, sf_dir):
    return tables.layout_pages(spark, sf_dir)


def _md5(c):
    return F.md5(c)


def _one(name, fn):
    @query(name)
    def q(spark, sf_dir):
        p = _pages(spark, sf_dir)
        return p.select("doc_id", _md5(fn()).alias("text_md5"))
    q.__doc__ = fn.__doc__
    return q


_one("strip_page_furniture", lambda: clean.strip_page_furniture("page_text"))
_one("strip_html_urls", lambda: clean.strip_html_urls("page_text"))
_one("header_a", lambda: clean.header_a("page_text"))
_one("header_b", lambda: clean.header_b("page_text"))
_one("header_c", lambda: clean.header_c("page_text"))
_one("strip_title_page", lambda: clean.strip_title_page("page_text", "title"))
_one("strip_title", lambda: clean.strip_title("page_text", "title"))
_one("strip_contribution", lambda: clean.strip_contribution("page_text"))


@query("strip_captions")
def strip_captions(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("doc_id", _md5(clean.strip_captions("page_text", "a")).alias("a_md5"),
                    _md5(clean.strip_captions("page_text", "b")).alias("b_md5"))


@query("strip_boilerplate")
def strip_boilerplate(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("doc_id", _md5(clean.strip_boilerplate("page_text", "a")).alias("a_md5"),
                    _md5(clean.strip_boilerplate("page_text", "c")).alias("c_md5"))


@query("truncate_tail")
def truncate_tail(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("doc_id", _md5(clean.truncate_tail("page_text", "b")).alias("b_md5"),
                    _md5(clean.truncate_tail("page_text", "c")).alias("c_md5"))


@query("extract_metadata")
def extract_metadata(spark, sf_dir):
    """First-match captures of date, byline and URL, per layout rule."""
    p = _pages(spark, sf_dir)
    return p.select("doc_id", clean.capture_date("page_text", "a").alias("date_a"),
                    clean.capture_author("page_text", "a").alias("author_a"),
                    clean.capture_url("page_text", "a").alias("url_a"),
                    clean.capture_date("page_text", "b").alias("date_b"),
                    clean.capture_author("page_text", "b").alias("author_b"))


@query("author_split")
def author_split(spark, sf_dir):
    """T10 on the layout-a byline."""
    p = _pages(spark, sf_dir)
    names = clean.split_authors(clean.capture_author("page_text", "a"))
    return p.select("doc_id", F.array_join(names, ";").alias("authors"), F.size(names).cast("bigint").alias("n_authors"))


@query("pubdate_parse")
def pubdate_parse(spark, sf_dir):
    """T11 under the three month rules."""
    p = _pages(spark, sf_dir)
    return p.select("doc_id", clean.pubdate(clean.capture_date("page_text", "a"), "a").alias("pub_a"),
                    clean.pubdate(clean.capture_date("page_text", "b"), "b").alias("pub_b"),
                    clean.pubdate(clean.capture_date("page_text", "a"), "c").alias("pub_c"))


@query("strip_author_bios")
def strip_author_bios(spark, sf_dir):
    """C11 with the layout-a byline names."""
    p = _pages(spark, sf_dir).withColumn("names", clean.split_authors(clean.capture_author("page_text", "a")))
    return p.select("doc_id", _md5(clean.strip_author_bios("page_text", "names")).alias("text_md5"))


@query("dispatch_clean")
def dispatch_clean(spark, sf_dir):
    """P10: layout chosen from the path."""
    p = _pages(spark, sf_dir)
    return p.select("doc_id", clean.layout_of("path").alias("layout"))


@query("clean_articles")
def clean_articles(spark, sf_dir):
    """C13 + P10: whole cleaning per layout; rows of an unknown layout are kept as
    rejects, with their path parts and nothing cleaned."""
    out = clean.clean_all(_pages(spark, sf_dir), "path", "page_text", "title")
    return out.select("doc_id", "layout", "author", "source", "is_target", "genre", "pub_date",
                      F.col("clean_title").alias("title"), _md5("clean_text").alias("text_md5"), "url")


@query("date_coerce")
def date_coerce(spark, sf_dir):
    """Text dates to DATE, failures NULL, with the failure count."""
    a = tables.articles(spark, sf_dir)
    d = a.select("article_id", clean.coerce_date("pub_date_raw").alias("pub_date"))
    n_bad = d.select(F.count_if(F.col("pub_date").isNull())).scalar()
    return d.withColumn("n_missing_dates", n_bad)


@query("path_metadata")
def path_metadata(spark, sf_dir):
    """Parts of each page URL (scheme, host, first path part)."""
    pg = tables.table(spark, sf_dir, "pages")
    return pg.select("page_id", T.path_part("url", 0).alias("part0"), T.path_part("url", 2).alias("host"),
                     T.path_part("url", 3).alias("part3"))
