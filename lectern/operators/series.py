"""Series with gaps, and what a step-by-step log adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.runtime import cut


def fill_gaps(df: DataFrame, group: str, order: str, value: str, into: str = "filled") -> DataFrame:
    """With the last value that isn't null up to each row, leading gaps with the first one of the series; all null stays null."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(into, F.coalesce(before, after))


def moving_average(df: DataFrame, group: str, order: str, value: str, width: int, into: str = "average") -> DataFrame:
    """With the mean of the last `width` values that aren't null; the first rows take the first full mean, gaps the value before.
    A series with fewer than `width` values is null throughout."""
    at = Window.partitionBy(group).orderBy(order)
    rank = F.count(value).over(at.rowsBetween(Window.unboundedPreceding, 0))
    # among the rows with a value the last `width` are those with the highest ranks: a range frame over the rank leaves gaps out
    full = F.avg(value).over(Window.partitionBy(group).orderBy("_rank").rangeBetween(-(width - 1), 0))
    rows = df.withColumn("_rank", rank).withColumn("_mean", full)
    first = F.min(F.when(F.col("_rank") == width, F.struct(F.col("_rank"), F.col("_mean").alias("m")))).over(Window.partitionBy(group))["m"]
    return rows.withColumn(into, F.when(F.col("_rank") >= width, F.col("_mean")).otherwise(first)).drop("_rank", "_mean")


def display_sizes(df: DataFrame, value: str, low: int, high: int, into: str = "shown") -> DataFrame:
    """(value, shown): the distinct values in order, spread evenly over low..high and rounded up; a single value is shown as low."""
    d = places(df.select(value).where(F.col(value).isNotNull()).distinct(), F.col(value).asc())
    n, rank = F.col("_count"), F.col("place")
    sized = d.join(F.broadcast(d.agg(F.count("*").alias("_count"))), how="cross")  # one row
    return sized.select(value, F.when(n == 1, low).otherwise(F.ceil(F.round(low + (rank - 1) * (high - low) / (n - 1), 9))).cast("int").alias(into))


def span_groups(spans: Column) -> Column:
    """The position in `spans` (array<struct<from, to>>, ends exclusive) of every index that they cover."""
    return F.flatten(F.transform(spans, lambda s, i: F.transform(F.sequence(s["from"], s["to"] - 1), lambda _: i)))


def step_change(df: DataFrame, group: str, order: str, value: str, into: str = "change") -> DataFrame:
    """With the difference to the row before; null in the first."""
    return df.withColumn(into, F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(order)))


def first_visits(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """The first row of each group by `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where("_n = 1").drop("_n")


def running_total(df: DataFrame, group: str, order: str, value: str, into: str = "total") -> DataFrame:
    return df.withColumn(into, F.sum(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def places(df: DataFrame, *order: Column) -> DataFrame:
    """`df` with each row's place (from 1) in the order of all rows. Rows are split by ranges of the order and numbered within a range, so
    no task sees all of them; the order should leave no ties."""
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    # a row's range holds from here on, because it is written
    parts = cut(parts)
    within = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))  # one row per range
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return within.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("place", F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")
