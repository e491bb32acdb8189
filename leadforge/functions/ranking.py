"""Row numbers and running sums over a global order without a single-task window.

A window with ``ORDER BY`` and no (or a coarse) ``PARTITION BY`` sends every row
of a group to one task. Here the order is cut into slices first:

1. the input is checkpointed, so that the passes below see the same rows, and
   the slice borders are read off once as quantiles of the first order column
   (at most ``MAX_SLICES - 1`` numbers on the driver);
2. a row's slice follows from its value and these fixed borders alone, by a
   binary search of literals: every plan that uses it agrees on it;
3. a window inside ``(group, slice)`` numbers the rows and runs the sums;
4. the totals per ``(group, slice)`` are a table of at most slices x groups
   rows; their running sum over the slices of a group is each slice's offset.

Rows whose first order value is equal share a slice; the column should be close
to unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SLICES = 512


def _between(key: Column, borders: list[float], lo: int = 0, hi: int | None = None) -> Column:
    """The number of borders below ``key``, as nested comparisons."""
    hi = len(borders) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key <= F.lit(borders[mid]), _between(key, borders, lo, mid)).otherwise(
        _between(key, borders, mid + 1, hi))


def slice_of(df: DataFrame, column: str, slices: int) -> Column:
    """Ascending slice number of a numeric column; null comes first."""
    points = [i / slices for i in range(1, slices)]
    if not points:
        return F.lit(0)
    found = df.agg(F.percentile_approx(F.col(column), points, 100 * slices).alias("q")).first()["q"]
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(_between(F.col(column), sorted(set(found or []))))


def ordered_running(
    df: DataFrame,
    order_cols: list[str],
    sum_cols: list[str] = (),
    group_cols: list[str] = (),
    rank_col: str = "rank",
    partitions: int | None = None,
    slice_expr: Column | None = None,
) -> DataFrame:
    """Add ``rank_col`` (1-based row number per group in order), ``cum_<c>`` (inclusive
    running sum per group), ``group_rows`` and ``total_<c>`` (group totals).

    ``order_cols`` must be a total order within each group for a deterministic result.
    The first one is numeric, or ``slice_expr`` gives the slice: a deterministic
    expression that does not fall along the order.
    """
    spark = df.sparkSession
    slices = min(MAX_SLICES, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    group_cols, sum_cols = list(group_cols), list(sum_cols)
    fixed = df.checkpoint()
    cut = slice_expr if slice_expr is not None else slice_of(fixed, order_cols[0], slices)
    sliced = fixed.withColumn("_pid", cut)

    inside = Window.partitionBy("_pid", *group_cols).orderBy(*order_cols)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = sliced.select(
        "*", F.row_number().over(inside).cast("bigint").alias("_local_rank"),
        *[F.coalesce(F.sum(F.col(c).cast("double")).over(running), F.lit(0.0)).alias(f"_local_{c}") for c in sum_cols])

    totals = sliced.groupBy("_pid", *group_cols).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast("double")).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    offsets = totals.select(
        F.col("_pid").alias("_o_pid"), *[F.col(g).alias(f"_o_{g}") for g in group_cols],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_rank"),
        F.sum("_n").over(whole).alias("group_rows"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0.0)).alias(f"_off_{c}") for c in sum_cols],
        *[F.coalesce(F.sum(f"_t_{c}").over(whole), F.lit(0.0)).alias(f"total_{c}") for c in sum_cols],
    )
    if not group_cols:
        offsets = F.broadcast(offsets)  # a row per slice: MAX_SLICES at most, or as many as slice_expr has values
    same = F.col("_pid") == F.col("_o_pid")
    for g in group_cols:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    joined = numbered.join(offsets, same, "inner")
    return joined.select(
        *df.columns,
        (F.col("_local_rank") + F.col("_off_rank")).alias(rank_col),
        *[(F.col(f"_local_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sum_cols],
        "group_rows",
        *[F.col(f"total_{c}") for c in sum_cols],
    )
