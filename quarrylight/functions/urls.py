"""URL and DOI expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions.text import fnv1a

# Parameters that only track, and parameters that identify a page.
TRACKING = "fbclid gclid dclid msclkid yclid igshid mc_cid mc_eid _ga _gl ref ref_src ref_url cmpid smid sref ocid mkt_tok spm share".split()
IDENTITY = "id p v abstract_id article_id articleid docid doc_id story_id".split()

_PARTS = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
DOI = r"(?i)\b(10\.[0-9]{4,9}/[^\s\"'<>{}\[\]|\\^`]+)"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, n)


def is_http_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(r"^(?i)https?://[^\s/?#]+\S*$"), F.lit(False))


def to_https(url: Column) -> Column:
    return F.regexp_replace(url, "^(?i)http://", "https://")


def host_of(url: Column) -> Column:
    """Lower-cased host without www; empty for what is no URL."""
    return F.when(is_http_url(url), F.regexp_replace(F.lower(_part(url, 2)), "^www[0-9]?\\.", "")).otherwise("")


def canonical_url(url: Column) -> Column:
    """One spelling for pages that are the same: https, bare host, no fragment, no tracking, sorted parameters.

    The query stays whole only where it names the page (root or script paths); elsewhere only identifying parameters stay.
    """
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    drop = lambda p: name(p).rlike("^(utm_|pk_)") | name(p).isin(TRACKING)

    def build(u: Column) -> Column:
        path, port, host, query = u["path"], u["port"], u["host"], u["query"]
        keep_all = (path == "/") | F.lower(path).rlike(r"\.(php|asp|aspx|jsp|cfm)$")
        asked = F.filter(F.split(query, "&"), lambda p: (p != "") & ~drop(p) & (keep_all | name(p).isin(IDENTITY)))
        pairs = F.array_join(F.array_sort(F.transform(asked, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")
        base = F.concat(F.lit("https://"), host, F.when((port != "") & ~port.isin("80", "443"), F.concat(F.lit(":"), port)).otherwise(""))
        bare = F.regexp_replace(path, "/+$", "")
        return _let(pairs, lambda q: F.when(q == "", F.concat(base, bare)).otherwise(F.concat(base, F.when(bare == "", "/").otherwise(bare), F.lit("?"), q)))

    host = F.regexp_replace(F.lower(_part(url, 2)), "^www[0-9]?\\.", "")
    path = _let(_part(url, 4), lambda p: F.when(p == "", "/").otherwise(p))
    parts = F.struct(host.alias("host"), _part(url, 3).alias("port"), path.alias("path"), _part(url, 5).alias("query"))
    return F.when(is_http_url(url), _let(parts, build)).otherwise(F.trim(url))


def _trim_tail(doi: Column) -> Column:
    """Trailing punctuation, and closing brackets without an opening one, go; a few rounds settle any real DOI."""

    def unbracket(d: Column, opening: str, closing: str) -> Column:
        lacks = F.length(F.replace(d, F.lit(opening), F.lit(""))) > F.length(F.replace(d, F.lit(closing), F.lit("")))
        return F.when(d.endswith(closing) & lacks, F.substring(d, F.lit(1), F.length(d) - 1)).otherwise(d)

    for _ in range(3):
        doi = F.regexp_replace(doi, "[.,;:'\">}]+$", "")
        doi = _let(doi, lambda d: unbracket(d, "(", ")"))
        doi = _let(doi, lambda d: unbracket(d, "[", "]"))
    return doi


def normalize_doi(doi: Column) -> Column:
    d = _let(F.trim(doi), lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))
    d = F.regexp_replace(d, r"^(?i)https?://(dx\.)?doi\.org/", "")
    d = F.regexp_replace(d, r"^(?i)doi:\s*", "")
    return _trim_tail(F.lower(F.trim(d)))


def clean_doi(doi: Column) -> Column:
    return _let(F.regexp_replace(normalize_doi(doi), "/(full|abstract|pdf|epdf|html)$", ""), lambda d: F.when(d.rlike(r"^10\.[0-9]{4,9}/\S+$"), d))


def find_doi(text: Column) -> Column:
    return _let(F.regexp_extract(text, DOI, 1), lambda found: F.when(found != "", clean_doi(found)))


def doi_from_url(url: Column) -> Column:
    """DOI of a resolver link or of a publisher path such as /doi/pdf/10..."""
    path = F.coalesce(F.try_url_decode(F.replace(_part(url, 4), F.lit("+"), F.lit("%2B"))), _part(url, 4))
    in_path = F.regexp_extract(path, r"(?i)/doi/(?:(?:abs|full|pdf|epdf|pdfdirect|epub|book)/)?(10\.[0-9]{4,9}/[^?#\s]+)", 1)
    resolver = host_of(url).rlike(r"(^|\.)doi\.org$")
    return F.when(resolver, find_doi(path)).when(in_path != "", clean_doi(in_path))


def candidate_id(doi: Column, url: Column) -> Column:
    return F.concat(F.lit("c_"), fnv1a(F.coalesce(normalize_doi(F.when(doi != "", doi)), canonical_url(url))))


def _fragment(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("-"), F.lit("%2D"))


def text_fragment_url(url: Column, passage: Column) -> Column:
    """Link that scrolls to a passage: whole up to eight words, else its first and last words."""
    words = F.filter(F.split(F.trim(F.regexp_replace(passage, r"\s+", " ")), " "), lambda w: w != "")
    n = F.size(words)
    tail = F.least(F.lit(5), n - 5)
    first, last = F.array_join(F.slice(words, 1, 5), " "), F.array_join(F.slice(words, n - tail + 1, F.greatest(tail, F.lit(0))), " ")
    anchor = F.when(n <= 8, _fragment(F.array_join(words, " "))).otherwise(F.concat(_fragment(first), F.lit(","), _fragment(last)))
    return F.when(n == 0, url).otherwise(F.concat(F.substring_index(url, "#", 1), F.lit("#:~:text="), anchor))


def pdf_page_url(url: Column, page: Column) -> Column:
    return F.when(page.isNull(), url).otherwise(F.concat(F.substring_index(url, "#", 1), F.lit("#page="), page.cast("string")))
