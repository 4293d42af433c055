"""Web pages as text: a chain of native expressions, with title, byline and date from the page's own statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import decode_entities
from quarrylight.sources.markdown import BODY_BEFORE_REFERENCES, REFERENCE_TITLES

#: Elements whose content is no text of the page, and elements that stand on lines of their own.
DROPPED = "script style noscript template svg nav header footer aside form button select iframe".split()
BLOCKS = "address article blockquote br dd div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table td th tr ul".split()
_STEPS = (
    [(r"(?s)<!--.*?-->", " ")]
    + [(rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ") for tag in DROPPED]
    + [
        (r"(?is)<sup(?:\s[^>]*)?>\s*(?:<a(?:\s[^>]*)?>)?\s*\[?\d{1,3}\]?\s*(?:</a\s*>)?\s*</sup\s*>", ""),
        (r"(?is)<title(?:\s[^>]*)?>.*?</title\s*>", " "),
        (r"\s+", " "),
        (r"(?i)</?(?:" + "|".join(BLOCKS) + r")(?:\s[^>]*)?/?>", "\n"),
        (r"<[^>]*>", ""),
        (r"[ \t]*\n\s*", "\n"),
        (r"^\s+|\s+$", ""),
    ]
)


def _meta(html: Column, names: str) -> Column:
    """The content of the first meta element of one of the names."""
    element = F.regexp_extract(html, rf"(?is)<meta\s[^>]*(?:name|property)\s*=\s*[\"'](?:{names})[\"'][^>]*>", 0)
    return F.nullif(F.trim(F.regexp_extract(element, r"(?is)content\s*=\s*[\"']([^\"']*)", 1)), F.lit(""))


def before_references(text: Column) -> Column:
    """The lines before the first title of a reference list that has enough text above it."""
    lines = F.split(text, "\n")
    title = lambda x: F.regexp_replace(F.lower(x), r"^[\d.\s]+|[\s:]+$", "").isin(REFERENCE_TITLES)
    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("above"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        ends = (s["end"] == 0) & (s["above"] > BODY_BEFORE_REFERENCES) & title(x)
        return F.struct((s["line"] + 1).alias("line"), (s["above"] + F.length(x)).alias("above"), F.when(ends, s["line"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(lines, start, step, lambda s: s["end"])
    return F.when(end > 0, F.array_join(F.slice(lines, F.lit(1), end - 1), "\n")).otherwise(text)


def page_text(html: Column) -> Column:
    """Lines of the page's blocks, without menus, forms and scripts, up to the reference list."""
    stripped = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), _STEPS, F.coalesce(html, F.lit("")))
    return before_references(decode_entities(stripped))


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, title, byline, published.  pages: page_id, url, html."""
    html = F.coalesce("html", F.lit(""))
    title = F.coalesce(_meta(html, "og:title|twitter:title"), F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1)), F.lit("")))
    published = F.nullif(F.regexp_extract(_meta(html, "article:published_time|date|dc.date|citation_publication_date"), r"^(\d{4}(?:-\d\d(?:-\d\d)?)?)", 1), F.lit(""))
    return pages.select("page_id", "url", page_text(html).alias("text"), decode_entities(title).alias("title"), decode_entities(_meta(html, "author|article:author|citation_author")).alias("byline"), published.alias("published"))
