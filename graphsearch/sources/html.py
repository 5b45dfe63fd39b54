"""Articles and links from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphsearch.functions import text
from graphsearch.functions.constants import NOT_ARTICLES


def _bare(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"&nbsp;", " ")
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(sign))
    return text.normalize(c)


def extract_articles(pages: DataFrame) -> DataFrame:
    """The columns of pages but html, and category, title, date, body, n_paragraphs; rows without a title or body go.

    The category is the last item of the breadcrumb, else the first part of the url's path in title
    case.  The title is the first h1, else the page's title; paragraphs are those outside of script, style,
    aside, table and figure.
    """
    html = F.coalesce("html", F.lit(""))
    h1 = _bare(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    head = _bare(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    date = F.coalesce(F.nullif(_bare(F.regexp_extract(html, r"(?is)<span[^>]*class=\"date\"[^>]*>(.*?)</span>", 1)), F.lit("")), F.regexp_extract(html, r"(?is)<meta[^>]*article:published_time[^>]*content=\"([^\"]*)\"", 1))
    clean = F.regexp_replace(html, r"(?is)<(script|style|aside|table|figure)\b.*?</\1>", "")
    paragraphs = F.filter(F.transform(F.regexp_extract_all(clean, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), _bare), lambda p: p != "")
    crumbs = F.regexp_extract(html, r"(?is)<(?:ul|div)[^>]*class=\"[^\"]*\bbreadcrumb\b[^\"]*\"[^>]*>(.*?)</(?:ul|div)>", 1)
    last = F.coalesce(F.try_element_at(F.transform(F.regexp_extract_all(crumbs, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)), _bare), F.lit(-1)), F.lit(""))
    category = F.coalesce(F.nullif(last, F.lit("")), category_of(F.col("url"))) if "url" in pages.columns else last
    rest = [c for c in pages.columns if c != "html"]
    made = pages.select(*rest, category.alias("category"), F.coalesce(F.nullif(h1, F.lit("")), head).alias("title"), date.alias("date"), F.array_join(paragraphs, "\n").alias("body"), F.size(paragraphs).cast("bigint").alias("n_paragraphs"))
    return made.where("title <> '' AND body <> ''")


def category_of(url: Column) -> Column:
    """The first part of the path, hyphens as spaces, in title case; empty without one."""
    return F.initcap(F.replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/]*//[^/?#]*/+([^/?#]+)", 1), F.lit("-"), F.lit(" ")))


def links(html: Column, base: Column) -> Column:
    """Distinct links in order, those of the site's root with its scheme and host before."""
    site = F.regexp_extract(base, r"^([^/]*//[^/?#]*)", 1)
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]+)"'), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.when(F.startswith(u, F.lit("/")), F.concat(site, u)).otherwise(u)))


def is_article(url: Column, host: str = "vnexpress.net") -> Column:
    bad = F.lit(False)
    for part in NOT_ARTICLES:
        bad = bad | F.contains(url, F.lit(part))
    return F.endswith(url, F.lit(".html")) & F.contains(url, F.lit(host)) & ~bad
