"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import WorkFolder


#: A centre with more than this share of the edges is hot; there are at most 2 / HOT_SHARE such centres.
HOT_SHARE = 0.001


def _with_least(edges: DataFrame, total: int, itself: bool) -> DataFrame:
    """Edges (u, v) with m, the least neighbour of u (``itself``: or u); hot centres by broadcast, all others by a join."""
    seen = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    seen = seen.withColumn("m", F.least("u", "m")) if itself else seen
    bar = int(HOT_SHARE * total)
    hot, cold = seen.where(F.col("n") > bar).drop("n"), seen.where(F.col("n") <= bar).drop("n")
    rest = edges.join(F.broadcast(hot.select("u")), "u", "left_anti").join(cold, "u")
    return edges.join(F.broadcast(hot), "u").unionByName(rest)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of (u, v) edges that is not a root; the root is the least node.

    Alternating large and small stars: each round hangs a node's larger neighbours, then its
    smaller ones, on the least it sees. Rounds follow the logarithm of the longest path; each
    is written to the work folder and compared with the last by a count and a checksum.
    """
    work = WorkFolder(edges.sparkSession, name)
    now = work.put("0", edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for k in range(1, rounds + 1):
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == last or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, mark[0], True).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.put(f"{k}-large", large)
        down = _with_least(large, mark[0], False)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = work.put(str(k), small)
        work.drop(str(k - 1), f"{k}-large")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
