"""Records of the same work found through identifiers, addresses or titles: grouping, merging and incremental merging.

Grouping never compares records pairwise: a record is joined to the smallest position that shares one of its keys, and
components of those edges are the groups.  A title that thousands share is one hub with thousands of edges, not millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import title_key
from quarrylight.functions.urls import candidate_id, canonical_url, normalize_doi
from quarrylight.operators.tables import cut
from quarrylight.operators.tiers import TIER_WEIGHT

#: Fields of a candidate; all others follow the base record.
FIELDS = "source_id source_ids tier title url pdf_url doi authors publisher published snippet text cited_by_count search_score search_rank for_counter low_quality is_wikipedia round".split()


def keys_of(doi: Column, url: Column, pdf_url: Column, title: Column) -> Column:
    """Keys in order of trust: doi, page address, file address, title of four words or more."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    keys = F.array(
        F.concat(F.lit("doi:"), normalize_doi(filled(doi))),
        F.concat(F.lit("url:"), canonical_url(filled(url))),
        F.concat(F.lit("url:"), canonical_url(filled(pdf_url))),
        F.concat(F.lit("title:"), title_key(filled(title))),
    )
    return F.array_compact(keys)


def group_by_keys(rows: DataFrame, node: str = "pos") -> DataFrame:
    """(node, component) for rows with an array column ``keys``; a component is named by its smallest node, and rows alone are their own."""
    keyed = rows.select(F.col(node).alias("node"), F.explode_outer("keys").alias("key"))
    hubs = keyed.where("key is not null").groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    edges = cut(keyed.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    both = edges.union(edges.select("b", "a"))
    names = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("name")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(names.select(F.col("node").alias("b"), "name"), "b").groupBy("a").agg(F.min("name").alias("near")).withColumnRenamed("a", "node")
        heard = names.join(near, "node").select("node", "name", F.least("name", "near").alias("new"))
        jumped = heard.join(names.select(F.col("node").alias("new"), F.col("name").alias("far")), "new")
        step = cut(jumped.select("node", F.least("new", "far").alias("name"), (F.least("new", "far") < F.col("name")).alias("moved")))
        names = step.select("node", "name")
        if not step.where("moved").limit(1).count():
            break
    return rows.select(F.col(node).alias("node")).join(names, "node", "left").select("node", F.coalesce("name", "node").alias("component"))


def merge_groups(rows: DataFrame, keep_identity: bool = False) -> DataFrame:
    """One record per ``component``; rows have ``pos``, ``component`` and the candidate fields.

    The richest record is the base (a file, then a text, then the longer snippet; first seen on a tie); the others, in order of pos, fill its gaps.
    With ``keep_identity`` the record with the smallest pos is the base and keeps id, pos and round.

    Every field is a minimum by some order, which tasks form for themselves before records meet; no group is gathered, however many records it has.
    The field of the first filled record in order is the base's own or else that of the first filled one by pos.
    """
    has = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0)
    richness = F.struct((-has("pdf_url")).alias("a"), (-has("text")).alias("b"), (-F.coalesce(F.length("snippet"), F.lit(0))).alias("c"), "pos")
    order = F.struct("pos") if keep_identity else richness
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    own = lambda c: F.min_by(c, order)
    first = lambda c, when: F.min_by(c, F.when(when, F.col("pos")))
    longest = lambda c, size: F.min_by(c, F.when(size(c) > 0, F.struct((-size(c)).alias("size"), "pos")))
    weight = F.element_at(F.create_map(*(F.lit(v) for pair in TIER_WEIGHT.items() for v in pair)), F.col("tier"))
    every = lambda c: F.every(F.coalesce(c, F.lit(False))).alias(c)
    filling = ("title", "pdf_url", "doi", "publisher", "published", "snippet", "search_score")
    extra = [own("candidate_id").alias("candidate_id")] if keep_identity else []
    packed = rows.groupBy("component").agg(
        F.min("pos").alias("pos"), *extra, *(own(c).alias(c) for c in ("source_id", "url")),
        *(own(c).alias(f"own_{c}") for c in (*filling, "authors", "text", "round", "source_ids")),
        *(first(c, filled(c)).alias(f"first_{c}") for c in filling),
        longest("authors", F.size).alias("longest_authors"), longest("text", F.length).alias("longest_text"),
        F.min_by("tier", F.struct((-F.coalesce(weight, F.lit(-1.0))).alias("less"), "pos")).alias("tier"),
        F.max("cited_by_count").alias("cited_by_count"), F.min("search_rank").alias("search_rank"), F.min("round").alias("least_round"),
        *(every(c) for c in ("for_counter", "low_quality", "is_wikipedia")),
    )
    # A date with more than a year, of the same year, takes the place of a bare year.
    dated = rows.where(F.length("published") > 4).groupBy(F.col("component").alias("__c"), F.substring("published", 1, 4).alias("__year")).agg(F.min_by("published", "pos").alias("fuller"))
    listed = F.when(F.size("source_ids") > 0, F.col("source_ids")).otherwise(F.array("source_id"))
    named = rows.select(F.col("component").alias("__c"), "pos", F.posexplode(listed).alias("i", "id")).groupBy("__c", "id").agg(F.min(F.struct("pos", "i")).alias("at"))
    named = named.groupBy("__c").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("named"))  # a row a source's name
    picked = lambda c: F.when(filled(f"own_{c}"), F.col(f"own_{c}")).otherwise(F.col(f"first_{c}"))
    out = packed.withColumns({c: picked(c) for c in filling})
    out = out.join(dated, (F.col("component") == F.col("__c")) & (F.substring("published", 1, 4) == F.col("__year")) & (F.length("published") == 4), "left").drop("__c", "__year")
    out = out.join(named, F.col("component") == F.col("__c"), "left")
    base_ids = F.when(F.size("own_source_ids") > 0, F.col("own_source_ids")).otherwise(F.array("source_id"))
    none = F.expr("cast(array() as array<string>)")
    out = out.withColumns({
        "source_ids": F.array_distinct(F.concat(base_ids, F.coalesce("named", none))),
        "title": F.coalesce("title", F.lit("")),
        "authors": F.coalesce(F.when(F.size("own_authors") > 0, F.col("own_authors")), "longest_authors", none),
        "published": F.coalesce("fuller", "published"),
        "text": F.coalesce(F.when(F.coalesce("own_text", F.lit("")) != "", F.col("own_text")), "longest_text"),
        "round": F.coalesce("own_round", "least_round") if keep_identity else F.col("least_round"),
    })
    out = out.select("component", "pos", *(["candidate_id"] if keep_identity else []), *FIELDS)
    return out if keep_identity else out.withColumn("candidate_id", candidate_id(F.col("doi"), F.col("url")))


def dedupe(rows: DataFrame) -> DataFrame:
    """One record per work.  rows: pos (order of arrival) and the candidate fields."""
    keyed = rows.select("pos", keys_of(F.col("doi"), F.col("url"), F.col("pdf_url"), F.col("title")).alias("keys"))
    groups = group_by_keys(keyed)
    return merge_groups(rows.join(groups.withColumnRenamed("node", "pos"), "pos"))


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """Adds n, the row's number from 1 in the order of a column: sorted ranges are numbered each for itself and moved up by the sizes of those before."""
    ranges = cut(rows.repartitionByRange(by).withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("size"))  # one row a partition
    before = F.coalesce(F.sum("size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(by))
    return ranges.join(F.broadcast(sizes.select("__range", before.alias("before"))), "__range").withColumn("n", own + F.col("before")).drop("__range", "before")


def matching(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """pos (incoming), old: the existing record that an incoming one's most trusted key hits, the earliest on a tie.  Both have pos, doi, url, pdf_url and title."""
    keys = keys_of(F.col("doi"), F.col("url"), F.col("pdf_url"), F.col("title"))
    held = existing.select(F.col("pos").alias("old"), F.explode(keys).alias("key")).groupBy("key").agg(F.min("old").alias("old"))
    asked = incoming.select("pos", F.posexplode(keys).alias("trust", "key"))
    return asked.join(held, "key").groupBy("pos").agg(F.min_by("old", F.struct("trust", "old")).alias("old"))


def merge_incremental(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A new round's records into a table: no existing record is dropped, moved or renamed; a match fills its gaps, the rest is appended.

    An incoming record (deduplicated first) joins the existing one that its most trusted key hits, the earliest on a tie.
    """
    new = dedupe(incoming).withColumn("in_pos", F.col("pos"))
    target = matching(existing, new.withColumn("pos", F.col("in_pos"))).withColumnRenamed("pos", "in_pos")
    last = existing.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))  # one row
    matched = new.join(target, "in_pos", "left").crossJoin(F.broadcast(last))
    # Newcomers get positions after the last.
    fresh = numbered(matched.where("old is null").select("in_pos"), "in_pos")
    placed = matched.join(fresh, "in_pos", "left").withColumn("component", F.coalesce("old", F.col("last") + F.col("n"))).drop("n")
    fold = existing.withColumn("component", F.col("pos")).select("component", "pos", "candidate_id", *FIELDS)
    more = placed.select("component", F.when(F.col("old").isNotNull(), F.col("last") + 1 + F.col("in_pos")).otherwise(F.col("component")).alias("pos"), "candidate_id", *FIELDS)
    return merge_groups(fold.unionByName(more), keep_identity=True).withColumn("pos", F.col("component")).drop("component")


def interleave(lists: DataFrame, limit: int) -> DataFrame:
    """claim_id, id, rank: ranked lists (claim_id, list_no, rank, id) dealt in turn, repeats dropped, numbered anew."""
    once = lists.groupBy("claim_id", "id").agg(F.min(F.struct("rank", "list_no")).alias("at"))
    order = Window.partitionBy("claim_id").orderBy("at.rank", "at.list_no", "id")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("claim_id", "id", (F.col("n") - 1).alias("rank"))


def empty_candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "pos long, candidate_id string, " + SCHEMA)


SCHEMA = (
    "source_id string, source_ids array<string>, tier string, title string, url string, pdf_url string, doi string, authors array<string>, publisher string, published string, "
    "snippet string, text string, cited_by_count long, search_score double, search_rank int, for_counter boolean, low_quality boolean, is_wikipedia boolean, round int"
)
