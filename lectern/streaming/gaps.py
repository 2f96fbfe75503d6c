"""The series operators over a stream: windowed means with a watermark, and the last value carried forward as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(events: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(group, start, mean, values) by tumbling window; rows later than `late` are dropped, null values don't count."""
    at = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = at.groupBy(group, F.window(time, width).alias("w")).agg(F.avg(value).alias("mean"), F.count(value).alias("values"))
    return w.select(group, F.col("w.start").alias("start"), "mean", "values")


def carry_forward(events: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, order, filled): each row with the last value of its group that isn't null, across batches. Leading gaps stay null: what
    follows isn't known yet. The state is one number per group."""
    kind = dict(events.dtypes)

    def run(key: tuple, parts: Iterator, state) -> Iterator:
        import pandas as pd

        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order)
        filled = rows[value].astype("float64")
        if last is not None and len(filled) and pd.isna(filled.iloc[0]):
            filled.iloc[0] = last
        filled = filled.ffill()
        if len(filled) and not pd.isna(filled.iloc[-1]):
            state.update((float(filled.iloc[-1]),))
        yield pd.DataFrame({group: rows[group], order: rows[order], "filled": filled})

    out = f"{group} {kind[group]}, {order} {kind[order]}, filled double"
    return events.select(group, order, value).groupBy(group).applyInPandasWithState(run, out, "last double", "append", "NoTimeout")
