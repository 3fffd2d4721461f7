"""Connected components by alternating stars, distributed; no list of links ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, hot_limit, join_hot


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step: tie each neighbour of u (large: those above u; small: those below, and u) to the least of them.

    Hubs, which have very many of the total links, are broadcast with their least neighbour, so no task gets a whole star.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        total *= 2
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if total < hot_limit(total):  # too few links for a hub
        met = both.join(least.drop("n"), "u")
    else:
        least = cut(least, "least")
        met = join_hot(both, least, ["u"], "n", total)
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node that links reach.

    Nodes without a link are not returned. Links with a null end or between a node and itself are passed over; repeated
    and reversed links count once; no links give no rows. Each round is written to the shared folder, so a lost
    executor costs at most one round.
    """
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        half = cut(_stars(now, True, mark[0]), "large-stars")
        then = cut(_stars(half, False, half.count()), "small-stars")
        forget(now, half)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
