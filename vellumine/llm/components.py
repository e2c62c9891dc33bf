"""Connected components of a link table, by alternating large and small stars; nothing is collected."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, written


MOST_HUBS, LEAST_HUB = 1000, 256


def _star(links: DataFrame, large: bool, n: int) -> DataFrame:
    """Links every neighbour on one side of ``u`` to the smallest neighbour. Minima are pre-aggregated before the shuffle.

    ``n``: the number of links. The neighbours of hubs, nodes with over 1 in ``MOST_HUBS`` of all link ends, of which
    there are fewer than that, meet their minimum by broadcast, so that a hub's links are no single task's work.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = written(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d"), "least")
    hubs = least.filter(F.col("d") > max(LEAST_HUB, 2 * n // MOST_HUBS)).select("u", "m")
    moved = near.filter("v > u") if large else near.filter("v < u")
    if hubs.isEmpty():
        met = moved.join(least, "u")
    else:
        many = F.broadcast(hubs)
        met = moved.join(many, "u", "left_anti").join(least, "u").select("u", "v", "m").union(moved.join(many, "u").select("u", "v", "m"))
    stars = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        stars = stars.union(least.select("u", F.col("m").alias("v")))
    return stars.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links``: longs u, v. Returns ``node, component_id`` for every node with a link; component_id is its smallest node.

    Each round is written to the shared folder, so lineage stays short. Stops once a round changes nothing.
    """
    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark or not seen["n"]:
            break
        mark = seen
        new = written(_star(written(_star(now, True, seen["n"]), "large"), False, seen["n"]), "small")
        drop(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
