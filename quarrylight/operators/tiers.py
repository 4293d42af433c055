"""Credibility of sources by domain: dimension tables and a host-suffix lookup without a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.urls import doi_from_url, host_of

# Weight of each tier.
TIER_WEIGHT = {"peer_reviewed": 1.0, "gov_igo": 0.95, "think_tank": 0.8, "major_news": 0.75, "preprint": 0.7, "web": 0.4}

# Well-known domains by kind, with the name to show.  Callers pass longer tables of their own.
DOMAINS = {
    "peer_reviewed": {
        "nature.com": "Nature", "science.org": "Science", "thelancet.com": "The Lancet", "nejm.org": "New England Journal of Medicine", "bmj.com": "The BMJ",
        "pnas.org": "PNAS", "plos.org": "PLOS", "sciencedirect.com": "ScienceDirect", "springer.com": "Springer", "wiley.com": "Wiley",
        "tandfonline.com": "Taylor & Francis", "sagepub.com": "SAGE", "oup.com": "Oxford University Press", "cambridge.org": "Cambridge University Press",
        "jstor.org": "JSTOR", "jamanetwork.com": "JAMA Network", "pubmed.ncbi.nlm.nih.gov": "PubMed", "ncbi.nlm.nih.gov": "NCBI", "ieee.org": "IEEE", "acm.org": "ACM",
        "royalsocietypublishing.org": "The Royal Society", "annualreviews.org": "Annual Reviews", "mdpi.com": "MDPI", "frontiersin.org": "Frontiers",
        "biomedcentral.com": "BioMed Central", "elifesciences.org": "eLife", "cell.com": "Cell Press", "aeaweb.org": "American Economic Association",
        "aps.org": "American Physical Society", "acs.org": "American Chemical Society", "rsc.org": "Royal Society of Chemistry",
        "apa.org": "American Psychological Association", "journals.uchicago.edu": "University of Chicago Press", "degruyter.com": "De Gruyter", "emerald.com": "Emerald",
        "karger.com": "Karger",
    },
    "preprint": {
        "arxiv.org": "arXiv", "biorxiv.org": "bioRxiv", "medrxiv.org": "medRxiv", "ssrn.com": "SSRN", "osf.io": "OSF", "nber.org": "NBER",
        "preprints.org": "Preprints.org", "researchsquare.com": "Research Square", "chemrxiv.org": "ChemRxiv", "psyarxiv.com": "PsyArXiv", "socarxiv.org": "SocArXiv",
        "eartharxiv.org": "EarthArXiv", "repec.org": "RePEc", "hal.science": "HAL", "iza.org": "IZA",
    },
    "gov_igo": {
        "who.int": "World Health Organization", "un.org": "United Nations", "worldbank.org": "World Bank", "imf.org": "International Monetary Fund", "oecd.org": "OECD",
        "europa.eu": "European Union", "ilo.org": "International Labour Organization", "cdc.gov": "CDC", "census.gov": "U.S. Census Bureau",
        "bls.gov": "Bureau of Labor Statistics", "ons.gov.uk": "Office for National Statistics", "abs.gov.au": "Australian Bureau of Statistics",
        "rba.gov.au": "Reserve Bank of Australia", "statcan.gc.ca": "Statistics Canada", "unesco.org": "UNESCO", "unicef.org": "UNICEF", "undp.org": "UNDP",
        "unhcr.org": "UNHCR", "wto.org": "World Trade Organization", "fao.org": "FAO", "iea.org": "International Energy Agency", "ipcc.ch": "IPCC",
        "bis.org": "Bank for International Settlements", "adb.org": "Asian Development Bank", "iadb.org": "Inter-American Development Bank", "wipo.int": "WIPO",
        "iaea.org": "IAEA", "nih.gov": "National Institutes of Health", "nasa.gov": "NASA", "noaa.gov": "NOAA", "epa.gov": "EPA", "fda.gov": "FDA",
        "federalreserve.gov": "Federal Reserve", "cbo.gov": "Congressional Budget Office", "gao.gov": "Government Accountability Office",
        "bankofengland.co.uk": "Bank of England", "destatis.de": "Destatis", "insee.fr": "INSEE", "istat.it": "Istat", "scb.se": "Statistics Sweden",
    },
    "think_tank": {
        "brookings.edu": "Brookings Institution", "rand.org": "RAND Corporation", "pewresearch.org": "Pew Research Center", "urban.org": "Urban Institute",
        "cato.org": "Cato Institute", "epi.org": "Economic Policy Institute", "chathamhouse.org": "Chatham House", "bruegel.org": "Bruegel", "cepr.org": "CEPR",
        "cfr.org": "Council on Foreign Relations", "csis.org": "Center for Strategic and International Studies", "carnegieendowment.org": "Carnegie Endowment",
        "heritage.org": "Heritage Foundation", "aei.org": "American Enterprise Institute", "americanprogress.org": "Center for American Progress",
        "piie.com": "Peterson Institute", "cbpp.org": "Center on Budget and Policy Priorities", "taxpolicycenter.org": "Tax Policy Center",
        "ifs.org.uk": "Institute for Fiscal Studies", "resolutionfoundation.org": "Resolution Foundation", "ippr.org": "IPPR", "kff.org": "KFF",
        "mathematica.org": "Mathematica", "wri.org": "World Resources Institute", "grattan.edu.au": "Grattan Institute", "ceps.eu": "CEPS", "diw.de": "DIW Berlin",
        "lowyinstitute.org": "Lowy Institute", "orfonline.org": "Observer Research Foundation",
    },
    "major_news": {
        "reuters.com": "Reuters", "apnews.com": "Associated Press", "bbc.com": "BBC", "bbc.co.uk": "BBC", "nytimes.com": "The New York Times",
        "washingtonpost.com": "The Washington Post", "theguardian.com": "The Guardian", "ft.com": "Financial Times", "economist.com": "The Economist",
        "wsj.com": "The Wall Street Journal", "bloomberg.com": "Bloomberg", "npr.org": "NPR", "lemonde.fr": "Le Monde", "spiegel.de": "Der Spiegel", "cnn.com": "CNN",
        "nbcnews.com": "NBC News", "cbsnews.com": "CBS News", "abcnews.go.com": "ABC News", "usatoday.com": "USA Today", "latimes.com": "Los Angeles Times",
        "time.com": "Time", "theatlantic.com": "The Atlantic", "politico.com": "Politico", "axios.com": "Axios", "pbs.org": "PBS", "propublica.org": "ProPublica",
        "cnbc.com": "CNBC", "independent.co.uk": "The Independent", "telegraph.co.uk": "The Telegraph", "aljazeera.com": "Al Jazeera", "dw.com": "Deutsche Welle",
        "france24.com": "France 24", "elpais.com": "El País", "corriere.it": "Corriere della Sera", "abc.net.au": "ABC Australia", "cbc.ca": "CBC",
        "thehindu.com": "The Hindu", "straitstimes.com": "The Straits Times", "scmp.com": "South China Morning Post",
    },
    "low_quality": {
        "blogspot.com": "", "wordpress.com": "", "medium.com": "", "quora.com": "", "reddit.com": "", "pinterest.com": "", "facebook.com": "", "tiktok.com": "",
        "coursehero.com": "", "chegg.com": "", "tumblr.com": "", "substack.com": "", "wixsite.com": "", "weebly.com": "", "fandom.com": "", "answers.com": "",
        "ezinearticles.com": "", "hubpages.com": "", "scribd.com": "", "slideshare.net": "", "studocu.com": "", "linkedin.com": "", "instagram.com": "", "x.com": "",
        "youtube.com": "",
    },
}
# Government host patterns and DOI prefixes of preprint servers.
GOVERNMENT = r"(^|\.)(gov|mil|int)$|(^|\.)(gov|gob|gouv|govt|go|gv|gub)\.[a-z]{2}$|(^|\.)gc\.ca$|(^|\.)nic\.in$"
PREPRINT_DOIS = ("10.48550", "10.1101", "10.2139", "10.31219", "10.31234", "10.31235", "10.20944", "10.21203", "10.3386", "10.26434")
#: Order in which kinds are asked for a host; the longest domain wins inside a kind.
ORDER = ("low_quality", "peer_reviewed", "preprint", "gov_igo", "think_tank", "major_news")


def domain_table(spark: SparkSession, domains: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """domain, kind, name: a small table, one row per domain and kind."""
    rows = [(d, kind, name) for kind, names in (domains or DOMAINS).items() for d, name in names.items()]
    return spark.createDataFrame(rows, "domain string, kind string, name string")


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]"""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def tiers(rows: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Adds tier, publisher_name, low_quality, is_wikipedia from the url.

    Each distinct host is exploded into its suffixes and joined by equality with the domain table; rows get their host's answer back.
    """
    hosted = rows.withColumn("host", host_of(F.col(url)))
    hosts = hosted.select("host").distinct().where("host <> ''")
    rank = F.element_at(F.create_map(*(F.lit(v) for i, k in enumerate(ORDER) for v in (k, i))), F.col("kind"))
    hits = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain")).join(domains, "domain")
    best = hits.groupBy("host").agg(F.min_by(F.struct("kind", "name"), F.struct(rank, -F.length("domain"))).alias("hit"))
    found = hosted.join(best, "host", "left")
    doi = doi_from_url(F.col(url))
    wiki, resolver = F.col("host").rlike(r"(^|\.)wikipedia\.org$"), F.col("host").isin("doi.org", "dx.doi.org")
    kind, government = F.col("hit.kind"), F.col("host").rlike(GOVERNMENT)
    preprint = F.substring_index(doi, "/", 1).isin(*PREPRINT_DOIS)
    # A government pattern stands between the listed government hosts and think tanks.
    tier = (
        F.when((F.col("host") == "") | wiki | (kind == "low_quality"), "web")
        .when(resolver, F.when(preprint, "preprint").when(doi.isNotNull(), "peer_reviewed").otherwise("web"))
        .when(kind.isin("peer_reviewed", "preprint", "gov_igo"), kind)
        .when(government, "gov_igo")
        .otherwise(F.coalesce(kind, F.lit("web")))
    )
    name = F.when(wiki, "Wikipedia").when((tier == kind) & (F.col("hit.name") != ""), F.col("hit.name"))
    return found.withColumns({"tier": tier, "publisher_name": name, "low_quality": F.coalesce(kind == "low_quality", F.lit(False)) & ~wiki, "is_wikipedia": wiki}).drop("hit")


def in_domains(rows: DataFrame, domains: DataFrame, include: bool = True, url: str = "url") -> DataFrame:
    """Rows whose host lies in (or, with include False, outside) a list of domains with their subdomains.  domains: domain."""
    hosts = rows.select(host_of(F.col(url)).alias("host")).distinct()
    listed = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain")).join(domains.select("domain").distinct(), "domain", "left_semi").select(F.col("host").alias("__host")).distinct()
    return rows.join(listed, host_of(F.col(url)) == F.col("__host"), "left_semi" if include else "left_anti")


def best_tier(rows: DataFrame, by: str) -> DataFrame:
    """Highest tier per group, by weight."""
    weight = F.create_map(*(F.lit(v) for pair in TIER_WEIGHT.items() for v in pair))
    return rows.groupBy(by).agg(F.max_by("tier", F.struct(weight[F.col("tier")], "tier")).alias("tier"))

