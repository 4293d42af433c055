"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import stash


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its smallest node.

    Each round every node takes the smallest name among itself and its neighbours, then the name that the node so
    named has (pointer jumping, so long chains close in few rounds).  Rounds are cut by tables in the
    shared folder; only the count of changes reaches the driver.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{label}-edges")
    names = stash(both.groupBy("a").agg(F.least("a", F.min("b")).alias("name")).withColumnRenamed("a", "node"), label)
    while True:
        near = both.join(names.select(F.col("node").alias("b"), "name"), "b").groupBy("a").agg(F.min("name").alias("near"))
        heard = names.join(near.withColumnRenamed("a", "node"), "node").select("node", "name", F.least("name", "near").alias("new"))
        jump = names.select(F.col("node").alias("new"), F.col("name").alias("far"))
        named = stash(heard.join(jump, "new").select("node", F.least("new", "far").alias("name"), (F.least("new", "far") < F.col("name")).alias("moved")), label)
        names = named.select("node", "name")
        if not named.where("moved").limit(1).count():
            return names.withColumnRenamed("name", "component")
