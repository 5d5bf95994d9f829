"""Connected components of a table of links, by stars: no link or component is collected anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.common import spread_out, written


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node in links (a, b).

    Large and small stars take turns (Kiveris et al.): each node ties its larger neighbours, then its
    smaller ones, to the smallest it knows, until every link leads to a component's smallest node. A node
    with very many links has them split over tasks (see spread_out).
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(spread_out(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(spread_out(low), "a").select("a", "b", "m")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = written(small, "links")
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count() or edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
