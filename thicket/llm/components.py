"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, small, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of its neighbours and itself; in all links u > v."""
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(up).groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top"))
    least = written(around.filter("top > u").select("u", F.least("u", "m").alias("m")))
    star = written(up.join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    discard(least)
    return star


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them; in all links u > v."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")))
    several = small(least.filter("m <> top").select("u", "m"))
    others = edges.join(several, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    star = written(least.select("u", F.col("m").alias("v")).unionByName(others).distinct())
    discard(least)
    return star


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): the smallest node that it reaches; a written table.

    Both steps only group by a node and join its minimum back, so a hub costs its links and no pairs of them.  Minima are
    summed before they are shuffled, written, and sent out where counted to be few, so that a hub's links stay where they
    are; beyond, both sides of the join are plain exchanges, of which Spark can split a hub's.  Each step is written to the
    shared folder, and the one before it deleted; rounds end when the links no longer change, which takes a number of rounds
    in the logarithm of the longest path.  Self-links and repeated links are passed over; nulls must
    not occur.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most):
        after = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if after == state or after[0] == 0:
            break
        state = after
        for star in (_large_star, _small_star):
            before, now = now, star(now)
            discard(before)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")))
    # an endpoint of a self-link alone is its own root
    loops = edges.filter("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    return written(found.unionByName(loops).groupBy("node").agg(F.min("root").alias("root")))
