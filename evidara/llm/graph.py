"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.runtime import remove, written

#: A node with more edges than this, and than one in MOST_HUBS of all edges, is a hub: there are at most MOST_HUBS.
HUB, MOST_HUBS = 1_000, 50_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): component is the smallest node reachable over edges (a, b), for every node with an edge.

    Alternating large-star and small-star contraction: each round sends every node's larger, then
    smaller, neighbours to the smallest one, until only stars are left. A round is joins and grouped
    minima over the edge list; no neighbourhood is gathered, so a hub may hold any part of the
    edges, and what is joined to its edges is sent to every task (two numbers for each of at most MOST_HUBS hubs).
    Rounds are written to the shared folder. Null and self edges are ignored; an empty edge
    list gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = written(e, "edges")
    seen = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if tuple(found) == seen or not found[0]:
            break
        seen = tuple(found)
        # Edges are (larger, smaller). A node's larger neighbours go to its smallest one, or to itself.
        least = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        if found[0] > HUB:
            hubs = now.groupBy("v").count().where(F.col("count") > max(HUB, found[0] // MOST_HUBS)).select("v")
            # One look at the edges tells those of hubs and joins them to what they need; only the others are joined again.
            of_hubs = hubs.join(least, "v", "left").select("v", F.coalesce("m", "v").alias("m"))
            told = now.join(F.broadcast(of_hubs), "v", "left")
            met = told.where("m is not null").select("u", "v", "m")
            met = met.union(told.where("m is null").select("u", "v").join(least, "v", "left").select("u", "v", "m"))
        else:
            met = now.join(least, "v", "left")
        large = met.select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s"))
        small = small.select(F.col("s.u").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct()
        after, new = written(small, "edges")
        remove(spark, path)
        now, path = after, new
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select("v", "v").distinct())
