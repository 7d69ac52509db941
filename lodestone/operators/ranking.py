"""Top-k per group, and exact global positions without a global window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialize

_ROW_BITS = 33


# From this many shuffle partitions on, hot groups are cut in slices first; ranks stay the same.
WIDE = 32


def salt_when_wide(df: DataFrame, key: str) -> Column | None:
    """A salt for ``top_k`` on clusters wide enough for one group to lag."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.col(key) if parts >= WIDE else None


def top_k(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salt: Column | None = None,
    salts: int = 16,
) -> DataFrame:
    """First ``k`` rows per group in a total order, numbered from 1.

    The literal bound lets Spark cut every group to ``k`` rows before its
    shuffle.  With ``salt`` a group is first cut in ``salts`` slices, so that
    one hot group is sorted by many tasks and only ``k * salts`` rows meet.
    """
    if salt is not None:
        slices = df.withColumn("_slice", F.pmod(F.xxhash64(salt), F.lit(salts)))
        by_slice = Window.partitionBy(*group, "_slice").orderBy(*order)
        cut = slices.withColumn("_in_slice", F.row_number().over(by_slice))
        df = cut.filter(F.col("_in_slice") <= k).drop("_slice", "_in_slice")
    by_group = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by_group)).filter(F.col(rank) <= k)


def running_total(
    df: DataFrame, order: Sequence[str | Column], weight: Column, total: str, label: str
) -> DataFrame:
    """Add the running sum of ``weight`` over the whole frame in a total order.

    Range partitions are sorted on their own and written once; only one sum per
    partition meets in one place to give each partition its starting point.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_weight", weight.cast("bigint")).repartitionByRange(parts, *order)
    numbered = ranged.sortWithinPartitions(*order).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    stored = materialize(numbered, label).withColumn("_part", F.shiftright("_row", _ROW_BITS))
    sums = stored.groupBy("_part").agg(F.sum("_weight").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: its size is bounded by the partition count above.
    starts = sums.select(
        "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_part").orderBy("_row")
    joined = stored.join(F.broadcast(starts), "_part")
    summed = joined.withColumn(total, F.col("_start") + F.sum("_weight").over(inside))
    return summed.drop("_weight", "_row", "_part", "_start")


def global_position(
    df: DataFrame,
    order: Sequence[str | Column],
    position: str = "position",
    label: str = "rows",
    columns: Callable[[DataFrame], DataFrame] | None = None,
    codec: str | None = None,
) -> DataFrame:
    """Add the 0-based position of every row in a total order.

    ``columns`` may add columns to the ordered rows, which are written with them.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    numbered = numbered if columns is None else columns(numbered)
    # The row id packs partition and row number; writing it fixes both.
    stored = materialize(numbered, label, codec).withColumn("_part", F.shiftright("_row", _ROW_BITS))
    counts = stored.groupBy("_part").agg(F.count("*").alias("_count"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_part", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start")
    )
    starts = starts if columns is None else materialize(starts, f"{label}-starts")
    inside = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = stored.join(F.broadcast(starts), "_part")
    return joined.withColumn(position, F.col("_start") + inside).drop("_row", "_part", "_start")


def even_sample(df: DataFrame, order: Sequence[str | Column], limit: int) -> DataFrame:
    """Rows at positions ``floor(i * n / limit)``; everything when limit >= n."""
    placed = global_position(df, order, "_position", "sample")
    n = placed.count()
    if limit >= n:
        return placed.drop("_position")
    index = f"((_position * {limit} + {n} - 1) div {n})"
    hit = F.expr(f"{index} < {limit} and ({index} * {n}) div {limit} = _position")
    return placed.filter(hit).drop("_position")


def nearest_rank(
    df: DataFrame, group: str, value: str, ratios: dict[str, float], label: str = "quantile"
) -> DataFrame:
    """Exact nearest-rank percentiles per group, from a distributed histogram.

    Equal values are counted before anything is ordered, and the cumulative
    counts come from range partitions, so no group is gathered by one task.
    """
    histogram = (
        df.filter(F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count("*").alias("_n"))
    )
    summed = running_total(histogram, [group, value], F.col("_n"), "_upto", label)
    whole = summed.groupBy(group).agg(
        F.sum("_n").alias("_size"), F.min(F.col("_upto") - F.col("_n")).alias("_base")
    )
    placed = summed.join(whole, group)
    last = F.col("_upto") - F.col("_base")
    first = last - F.col("_n")

    def pick(ratio: float) -> Column:
        target = F.least(F.greatest(F.ceil(F.col("_size") * ratio), F.lit(1)), F.col("_size"))
        return F.min(F.when((first < target) & (target <= last), F.col(value)))

    return placed.groupBy(group).agg(
        F.first("_size").alias("n"), *[pick(r).alias(name) for name, r in ratios.items()]
    )
