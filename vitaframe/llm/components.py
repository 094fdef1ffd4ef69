"""Connected components of a link table, by alternating large and small stars.

Both steps are a grouped minimum joined back to the links, so no neighbour list
is ever gathered in one row. The minima are written before they are joined: both
sides of the join are then plain exchanges, and Spark splits the partition of a
hub that many links share. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


def _least(e: DataFrame, name: str) -> DataFrame:
    return written(e.groupBy("a").agg(F.min("b").alias("m")), name)


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "least").select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, "least")
    return down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component): for every id in a link between two ids the smallest one it reaches; written, the rounds' tables deleted.

    Nulls and loops are ignored; repeated links and an empty table are fine.
    """
    with scratch(links.sparkSession) as keep:
        e = written(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        mark = None
        while (now := e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != mark and now[0]:
            mark, e = now, written(_small(written(_large(e), "links")), "links")
        own = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct().join(e.select(F.col("a").alias("id")), "id", "left_anti")
        return written(own.union(roots), "components", keep)
