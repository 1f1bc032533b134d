"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.session import save_and_reload


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is.

    Beyond that the join is a shuffled one, whose skewed keys Spark splits.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its closed neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    moved = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    return moved.filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them. Links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Links with a null end or both ends equal are dropped; no links give no rows. Each
    round is a stored table, so a lost executor costs one round. Rounds grow with
    the logarithm of a component's size, and a round's rows are at most its links.
    """
    ends = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    ends = save_and_reload(ends.filter("a < b").distinct(), "links")
    state = None
    while True:
        ends = save_and_reload(_small_star(_star(ends)), "links")
        now = ends.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
    members = ends.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.union(ends.select("a", "a")).distinct()
