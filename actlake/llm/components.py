"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlake.llm.common import HOT_ROWS, Workspace, hot_keys, spread_join


def components(ws: Workspace, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (its smallest id) of every id in links, but for the smallest ids themselves.

    Alternates large-star and small-star steps until nothing changes; the number of rounds grows with the logarithm
    of the graph's size. A star's smallest member is a grouped minimum, which is taken in parts before the shuffle, and
    the edges of a hub are dealt to several tasks when they are joined with it.
    """

    def stars(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
        """u, its smallest v and the hubs among the u of at most n edges."""
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        if n <= HOT_ROWS:  # no hub can be among them
            return least.drop("n"), None
        least = ws.save(least)
        return least.drop("n"), hot_keys(least, ["u"])

    def large_star(edges: DataFrame, n: int) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, hubs = stars(both, 2 * n)
        least = least.select("u", F.least("u", "m").alias("m"))
        return spread_join(both.where("v > u"), least, ["u"], hubs, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(edges: DataFrame, n: int) -> DataFrame:
        least, hubs = stars(edges, n)
        rest = spread_join(edges, least, ["u"], hubs, ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.unionByName(least.select("u", F.col("m").alias("v")))

    state = lambda df: df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    edges = ws.save(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = state(edges)
    while True:
        turned = ws.save(large_star(edges, seen[0]).where("u <> v").distinct())
        new = ws.save(small_star(turned, seen[0]).distinct())
        before, seen = seen, state(new)
        ws.drop(edges, turned)
        edges = new
        if before == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
