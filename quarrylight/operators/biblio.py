"""Bibliography: author names, work records, reference strings in three styles, quotations and the exported evidence pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.dates import apa_date, long_date, mla_date, parse_date
from quarrylight.functions.text import count_words, normalize_ws

# Words that make a name an organisation's, particles of family names, and suffixes.
ORGANISATION = r"(?i)\b(university|institute|organi[sz]ation|bank|fund|agency|department|ministry|council|committee|commission|association|society|center|centre|office|bureau|group|network|foundation|team|staff|inc|ltd|llc|press|news)\b"
PARTICLES = r"(?i)^(van|von|der|den|de|da|di|del|della|la|le|du|dos|ter|ten|bin|al)$"
SUFFIXES = r"(?i)^(jr|sr|ii|iii|iv)\.?$"
BLOCK_QUOTE_WORDS = 40


def name_parts(name: Column) -> Column:
    """struct(family, given, suffix, org) of one author's name."""

    def split(n: Column) -> Column:
        words = F.split(n, " ")
        suffix = F.when((F.size(words) > 2) & F.element_at(words, -1).rlike(SUFFIXES), F.element_at(words, -1))
        core = F.when(suffix.isNotNull(), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(words)

        def cut(w: Column) -> Column:
            # A family name begins at its first particle, else it is the last word.
            marks = F.filter(F.sequence(F.lit(2), F.greatest(F.size(w) - 1, F.lit(2))), lambda i: (i < F.size(w)) & F.try_element_at(w, i).rlike(PARTICLES))
            at = F.coalesce(F.try_element_at(marks, F.lit(1)), F.size(w))
            return F.struct(F.array_join(F.slice(w, at, F.size(w) - at + 1), " ").alias("family"), F.array_join(F.slice(w, 1, F.greatest(at - 1, F.lit(0))), " ").alias("given"), F.regexp_replace(suffix, ",", "").alias("suffix"), F.lit(False).alias("org"))

        comma = F.struct(F.trim(F.substring_index(n, ",", 1)).alias("family"), F.trim(F.regexp_extract(n, r"^[^,]*,(.*)$", 1)).alias("given"), F.lit(None).cast("string").alias("suffix"), F.lit(False).alias("org"))
        org = F.struct(n.alias("family"), F.lit("").alias("given"), F.lit(None).cast("string").alias("suffix"), F.lit(True).alias("org"))
        person = F.element_at(F.transform(F.array(core), cut), 1)
        return F.when(n.rlike(ORGANISATION) | (F.size(words) == 1), org).when(n.contains(",") & ~F.trim(F.substring_index(n, ",", -1)).rlike(SUFFIXES), comma).otherwise(person)

    return F.element_at(F.transform(F.array(normalize_ws(name)), split), 1)


def authors(names: Column) -> Column:
    """Authors as parts: strings that list several people are cut, junk goes, each name stands once, in order."""
    several = F.flatten(F.transform(names, lambda n: F.split(n, r"\s*;\s*|\s+and\s+(?=\p{Lu})")))
    clean = F.filter(F.transform(several, lambda n: F.trim(F.regexp_replace(normalize_ws(n), r"^(?i)by\s+|[.,;]+$", ""))), lambda n: n.rlike(r"\p{L}{2}") & ~n.rlike(r"(?i)^(unknown|anonymous|n/?a|admin|editor|https?:.*)$"))
    key = lambda n: F.lower(F.regexp_replace(n, r"[^\p{L}]", ""))
    once = F.aggregate(clean, F.expr("cast(array() as array<string>)"), lambda done, n: F.when(F.exists(done, lambda d: key(d) == key(n)), done).otherwise(F.concat(done, F.array(n))))
    return F.transform(once, name_parts)


def _initials(given: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(given, r"[\s.]+"), lambda w: w != ""), lambda w: F.array_join(F.transform(F.split(w, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lit("."))), "-")), " ")


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that it refers to several times, which is worked out once."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _listed(names: Column, last: str, comma_before: bool = True) -> Column:
    """names has to be bound by ``_once``."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(names, 1)).otherwise(F.concat(head, F.lit((", " if comma_before else " ") + last + " "), F.element_at(names, -1)))


def apa_authors(a: Column) -> Column:
    one = F.transform(a, lambda x: F.when(x["org"] | (x["given"] == ""), x["family"]).otherwise(F.concat_ws(", ", x["family"], _initials(x["given"]), x["suffix"])))
    many = lambda one: F.concat(F.array_join(F.slice(one, 1, 19), ", "), F.lit(", … "), F.try_element_at(one, F.lit(-1)))
    return _once(one, lambda one: F.when(F.size(one) > 20, many(one)).otherwise(_listed(one, "&")))


def chicago_authors(a: Column) -> Column:
    one = F.transform(a, lambda x, i: F.when(x["org"] | (x["given"] == ""), x["family"]).when(i == 0, F.concat_ws(", ", x["family"], x["given"], x["suffix"])).otherwise(F.concat_ws(" ", x["given"], x["family"], x["suffix"])))
    many = lambda one: F.concat(F.array_join(F.slice(one, 1, 7), ", "), F.lit(", et al."))
    return _once(one, lambda one: F.when(F.size(one) > 10, many(one)).otherwise(_listed(one, "and")))


def mla_authors(a: Column) -> Column:
    one = F.transform(a, lambda x, i: F.when(x["org"] | (x["given"] == ""), x["family"]).when(i == 0, F.concat_ws(", ", x["family"], x["given"])).otherwise(F.concat_ws(" ", x["given"], x["family"])))
    return _once(one, lambda one: F.when(F.size(one) > 2, F.concat(F.element_at(one, 1), F.lit(", et al."))).otherwise(_listed(one, "and")))


def works(results: DataFrame) -> DataFrame:
    """Work records for citing: kind, authors, clean title, container, date and locator.

    results: claim_id, rank, title, authors, publisher, published, tier, doi, url.
    """
    outlet = F.concat(F.lit(r"\s+[|–—-]\s+\Q"), F.coalesce("publisher", F.lit("\u0001")), F.lit(r"\E$"))
    title = F.regexp_replace(normalize_ws(F.col("title")), outlet, F.lit(""))
    kind = F.when(F.col("tier") == "peer_reviewed", "article").when(F.col("tier") == "preprint", "preprint").when(F.col("tier") == "major_news", "news").when(F.col("tier").isin("gov_igo", "think_tank"), "report").otherwise("web")
    rows = results.withColumn("kind", kind).withColumn("people", authors(F.coalesce("authors", F.expr("cast(array() as array<string>)"))))
    org = F.array(F.struct(F.col("publisher").alias("family"), F.lit("").alias("given"), F.lit(None).cast("string").alias("suffix"), F.lit(True).alias("org")))
    rows = rows.withColumn("people", F.when((F.size("people") == 0) & F.col("publisher").isNotNull() & (F.col("kind") == "report"), org).otherwise(F.col("people")))
    sole = (F.size("people") == 1) & (F.element_at("people", 1)["family"] == F.col("publisher"))
    locator = F.coalesce(F.concat(F.lit("https://doi.org/"), F.when(F.col("doi") != "", F.col("doi"))), F.col("url"))
    return rows.select("claim_id", "rank", "kind", "people", title.alias("title"), F.when(~F.coalesce(sole, F.lit(False)), F.col("publisher")).alias("container"), parse_date(F.col("published")).alias("date"), locator.alias("locator"))


def _ended(c: Column) -> Column:
    return F.concat(c, F.when(F.right(c, F.lit(1)).isin(*".?!…"), "").otherwise("."))


def references(w: DataFrame, accessed: str) -> DataFrame:
    """claim_id, rank, style, reference: plain text in APA 7, Chicago author-date and MLA 9; access dates only for undated pages."""
    # The names are referred to several times below; as columns of their own they are worked out once a work.
    w = w.withColumns({"__apa": apa_authors(F.col("people")), "__chicago": chicago_authors(F.col("people")), "__mla": mla_authors(F.col("people"))})
    d, title, box, link = F.col("date"), F.col("title"), F.col("container"), F.col("locator")
    undated = d["year"].isNull()
    some = F.size("people") > 0
    join = lambda *parts: F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))
    apa_day = F.when(F.col("kind").isin("article", "preprint", "report"), F.coalesce(d["year"].cast("string"), F.lit("n.d."))).otherwise(apa_date(d))
    apa = F.when(some, join(_ended(F.col("__apa")), F.concat(F.lit("("), apa_day, F.lit(").")), _ended(title), F.coalesce(_ended(box), F.lit("")), F.when(undated, F.lit(f"Retrieved {accessed}, from")).otherwise(""), link)).otherwise(
        join(_ended(title), F.concat(F.lit("("), apa_day, F.lit(").")), F.coalesce(_ended(box), F.lit("")), F.when(undated, F.lit(f"Retrieved {accessed}, from")).otherwise(""), link)
    )
    quoted = F.concat(F.lit("“"), _ended(title), F.lit("”"))
    year = F.concat(F.coalesce(d["year"].cast("string"), F.lit("n.d.")), F.lit("."))
    full = F.when(F.col("kind").isin("news", "web") & d["month"].isNotNull(), F.concat(F.coalesce(box, F.lit("")), F.lit(", "), long_date(d), F.lit("."))).otherwise(F.coalesce(_ended(box), F.lit("")))
    chicago = join(F.when(some, _ended(F.col("__chicago"))).otherwise(""), year, quoted, full, F.when(undated, F.lit(f"Accessed {accessed}.")).otherwise(""), _ended(link))
    mla_tail = F.concat(F.concat_ws(", ", box, mla_date(d), F.regexp_replace(link, "^https?://", "")), F.lit("."))
    mla = join(F.when(some, _ended(F.col("__mla"))).otherwise(""), quoted, mla_tail, F.when(undated, F.lit(f"Accessed {accessed}.")).otherwise(""))
    styles = F.array(*(F.struct(F.lit(n).alias("style"), c.alias("reference")) for n, c in (("apa", apa), ("chicago", chicago), ("mla", mla))))
    return w.select("claim_id", "rank", F.explode(styles).alias("s")).select("claim_id", "rank", "s.style", "s.reference")


def page_range(first: Column, last: Column) -> Column:
    """12-15, with the last page shortened to two digits inside a hundred, as one style has it."""
    a, b = first.cast("string"), last.cast("string")
    short = F.when((first >= 100) & (F.floor(first / 100) == F.floor(last / 100)), F.lpad((last % 100).cast("string"), 2, "0")).otherwise(b)
    return F.when(last.isNull() | (first == last), a).otherwise(F.concat(a, F.lit("-"), short))


def in_text(w: DataFrame) -> DataFrame:
    """claim_id, rank, in_text: (Family, year), two names, or et al.; the title where there is no author."""
    p = F.col("people")
    who = F.when(F.size(p) == 0, F.concat(F.lit("“"), F.col("title"), F.lit("”"))).when(F.size(p) == 1, F.element_at(p, 1)["family"]).when(F.size(p) == 2, F.concat(F.element_at(p, 1)["family"], F.lit(" & "), F.element_at(p, 2)["family"])).otherwise(F.concat(F.element_at(p, 1)["family"], F.lit(" et al.")))
    return w.select("claim_id", "rank", F.concat(F.lit("("), who, F.lit(", "), F.coalesce(F.col("date.year").cast("string"), F.lit("n.d.")), F.lit(")")).alias("in_text"))


def page_span(pages: Column) -> Column:
    """struct(first, last) of a passage's pages; last only where there are several."""
    real = F.filter(pages, lambda p: p > 0)
    return F.struct(F.array_min(real).alias("first"), F.when(F.array_max(real) > F.array_min(real), F.array_max(real)).alias("last"))


def in_text_styles(w: DataFrame) -> DataFrame:
    """claim_id, rank, style, in_text: references in the running text in three styles, with the passage's pages.

    w: ``works`` with a column pages (array of page numbers, or null).
    """
    family = F.transform("people", lambda p: p["family"])
    year, n = F.coalesce(F.col("date.year").cast("string"), F.lit("n.d.")), F.size("people")
    span = page_span(F.col("pages"))
    both = F.concat_ws("–", span["first"].cast("string"), span["last"].cast("string"))
    title = F.concat(F.lit("“"), F.col("title"), F.lit("”"))

    def who(joint: str) -> Column:
        pair = F.array_join(F.slice(family, 1, 2), f" {joint} ")
        return F.when(n == 0, title).when(n <= 2, pair).otherwise(F.concat(F.element_at(family, 1), F.lit(" et al.")))

    bracket = lambda between, *parts: F.concat(F.lit("("), F.concat_ws(between, *(F.nullif(p, F.lit("")) for p in parts)), F.lit(")"))
    located = F.when(span["first"].isNotNull(), F.concat(F.when(span["last"].isNull(), "p. ").otherwise("pp. "), both))
    apa = bracket(", ", who("&"), year, located)
    chicago = bracket(", ", F.concat_ws(" ", who("and"), year), both)
    mla = bracket(" ", who("and"), page_range(span["first"], span["last"]))
    styles = F.array(*(F.struct(F.lit(name).alias("style"), c.alias("in_text")) for name, c in (("apa", apa), ("chicago", chicago), ("mla", mla))))
    return w.select("claim_id", "rank", F.explode(styles).alias("s")).select("claim_id", "rank", "s.style", "s.in_text")


def debate_cites(w: DataFrame, accessed: str) -> DataFrame:
    """claim_id, rank, cite: author, year, "Title," outlet, address, accessed date; what is missing leaves no comma."""
    names = F.transform("people", lambda p: F.when(p["org"] | (p["given"] == ""), p["family"]).otherwise(F.concat_ws(" ", p["given"], p["family"])))
    author = F.when(F.size(names) > 2, F.concat(F.element_at(names, 1), F.lit(" et al."))).when(F.size(names) > 0, F.array_join(names, " and "))
    title = F.concat(F.lit("“"), F.col("title"), F.when(F.col("title").rlike("[.?!…]$"), "").otherwise(","), F.lit("”"))
    before, after = F.concat_ws(", ", author, F.col("date.year").cast("string")), F.concat_ws(", ", "container", "locator", F.lit(f"accessed {accessed}"))
    return w.select("claim_id", "rank", F.concat_ws(" ", F.when(before != "", F.concat(before, F.lit(","))), title, after).alias("cite"))


def evidence_pack(results: DataFrame, refs: DataFrame) -> DataFrame:
    """claim_id, markdown: per claim its sources in order, each with title and link, summary, quotation, honesty line and reference.

    results: claim_id, rank, title, url, passage, summary, relation, text_source; refs: claim_id, rank, reference.
    """
    quote = F.when(count_words(F.col("passage")) >= BLOCK_QUOTE_WORDS, F.concat(F.lit("> "), F.regexp_replace("passage", r"\n", "\n> "))).otherwise(F.concat(F.lit("“"), F.col("passage"), F.lit("”")))
    honest = F.when(F.col("text_source") == "abstract_only", "Checked against the abstract only.").otherwise("Checked word for word against the stored text.")
    part = F.concat_ws("\n\n", F.concat(F.lit("### ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")")), F.when(F.col("summary") != "", F.col("summary")), quote, F.concat(F.lit("*"), F.initcap("relation"), F.lit(". "), honest, F.lit("*")), F.col("reference"))
    rows = results.join(refs, ["claim_id", "rank"], "left").select("claim_id", F.struct("rank", part.alias("part")).alias("p"))
    return rows.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "\n\n").alias("markdown"))


def picked_results(picks: DataFrame, results: DataFrame) -> DataFrame:
    """Chosen results in the order of choice; unknown ids are skipped.  picks: claim_id, picked (array of candidate_id)."""
    rows = picks.select("claim_id", F.posexplode("picked").alias("pos", "candidate_id"))
    return rows.join(results.drop("rank"), ["claim_id", "candidate_id"]).withColumn("rank", F.col("pos") + 1).drop("pos")
