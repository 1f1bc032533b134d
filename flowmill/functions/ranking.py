"""Exact ranks and running totals over groups of any size.

``row_number()`` over a group that holds a third of a table sorts that third in
one task. Here a group is cut into order-preserving buckets: a map-side
aggregated count per (group, bucket) is prefix-summed to give each bucket its
offset, and only rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.session import save_and_reload


def hash_bucket(digest: Column, digits: int = 4) -> Column:
    """Order-preserving bucket of a hex digest: its first ``digits`` digits."""
    return F.substring(digest, 1, digits)


def running_before(
    df: DataFrame, order: list[str], sums: dict[str, str], tops: dict[str, Column] | None = None,
    whole: dict[str, str] | None = None,
) -> DataFrame:
    """Add, for each row, totals of the rows before it in ``order`` over the whole table.

    ``sums`` names new columns and the columns whose sum they take, 0 at the first row; ``tops`` new
    columns and the expressions, also of those sums, whose maximum they take, null at the first
    row. ``whole`` names new columns and the columns of ``sums`` (by their new name) whose total over all rows they take.
    A scan in two levels: the rows are dealt into ranges of ``order``, each range's totals are
    scanned, and the rest is a window inside the range. Only the totals, one row for each
    range, are ever seen by one task. ``order`` must tell rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored, so that the ranges stay what they are when a task is run again.
    rows = save_and_reload(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if sums:
        totals = rows.groupBy("_range").agg(*[F.sum(old).alias(f"_{new}") for new, old in sums.items()])
        totals = totals.select(
            "_range", *[F.coalesce(F.sum(f"_{new}").over(ranges), F.lit(0)).alias(f"_{new}") for new in sums],
            *[F.sum(f"_{new}").over(every).alias(name) for name, new in (whole or {}).items()])
        rows = rows.join(totals, "_range").withColumns({
            new: F.coalesce(F.sum(old).over(within), F.lit(0)) + F.col(f"_{new}") for new, old in sums.items()})
        rows = rows.drop(*[f"_{new}" for new in sums])
    if tops:
        totals = rows.groupBy("_range").agg(*[F.max(value).alias(f"_{new}") for new, value in tops.items()])
        totals = totals.select("_range", *[F.max(f"_{new}").over(ranges).alias(f"_{new}") for new in tops])
        rows = rows.join(totals, "_range").withColumns({
            new: F.greatest(F.max(value).over(within), F.col(f"_{new}")) for new, value in tops.items()})
        rows = rows.drop(*[f"_{new}" for new in tops])
    return rows.drop("_range")


def with_rank(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    bucket: Column,
    *,
    rank: str = "rank",
    total: str | None = None,
    keep: Column | None = None,
    once: bool = False,
) -> DataFrame:
    """Add the 0-based rank of each row within its group.

    ``bucket`` must be non-decreasing in ``order`` and not null. ``total`` names a column for
    the group size. ``keep`` is a condition on the rank (and total) columns,
    for instance ``F.col("rank") < 500``: buckets that start beyond it are
    dropped before any row is sorted. It must be monotone: once false at a
    rank, false at all later ranks. With ``once`` the rows are stored, ranks are found on the order
    columns alone, and each row meets its rank in one join: for wide or dearly computed rows.
    """
    if once:
        stored = save_and_reload(df.withColumn("_row", F.monotonically_increasing_id()), "ranked")
        ranks = with_rank(stored, by, order, bucket, rank=rank, total=total, keep=keep)
        ranks = ranks.select("_row", rank, *([total] if total else []))
        return stored.join(ranks, "_row").drop("_row")
    # The group is held in one struct: equal also where a key is null, and the
    # same two columns serve the join and the window, so rows move once.
    cut = df.withColumn("_bucket", bucket)
    keys = ["_bucket"]
    if by:
        cut = cut.withColumn("_group", F.struct(*by))
        keys = ["_group", "_bucket"]
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if by:
        group = Window.partitionBy("_group")
        before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        if total:
            sizes = sizes.withColumn(total, F.sum("_rows").over(group))
    else:
        sizes = running_before(sizes, ["_bucket"], {"_before": "_rows"}, whole={total: "_before"} if total else None)
    sizes = sizes.drop("_rows")
    if keep is not None:
        sizes = sizes.withColumn(rank, F.col("_before")).filter(keep).drop(rank)
    joined = cut.join(sizes, keys)
    within = Window.partitionBy(*keys).orderBy(*order)
    ranked = joined.withColumn(
        rank, (F.col("_before") + F.row_number().over(within) - 1).cast("bigint")
    )
    if keep is not None:
        ranked = ranked.filter(keep)
    return ranked.drop("_before", *keys)
