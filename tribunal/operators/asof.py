"""As-of joins: each row with what a log said last, at its time or before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, log: DataFrame, by: list[str], at: str, value: str, stretch: Callable[[Column], Column], seq: str | None = None) -> DataFrame:
    """rows (by, at and more, but no `value`) with the last non-null value of log (by, at, value) whose time is no later; null where there is none.

    stretch: what stretch of time a time is in; it must not fall as the time rises. Each key's stretches are sorted by themselves and start from what those
    before them left, so a key of any number of rows is as many tasks as it has stretches. Of entries of one time the last by seq, else by value, holds.
    Null keys are a key; rows without a time find nothing.
    """
    whole = F.struct(*rows.columns)
    kind = {c: log.schema[c].dataType for c in (value, *([seq] if seq else []))}
    nth = F.col(seq) if seq else F.lit(0).cast("long")
    entries = log.where(F.col(value).isNotNull() & F.col(at).isNotNull()).select(*by, F.col(at).alias("__at"), nth.alias("__nth"), F.col(value).alias("__value"), F.lit(None).cast(rows.select(whole.alias("r")).schema["r"].dataType).alias("__row"))
    asked = rows.select(*by, F.col(at).alias("__at"), F.lit(None).cast(entries.schema["__nth"].dataType).alias("__nth"), F.lit(None).cast(kind[value]).alias("__value"), whole.alias("__row"))
    both = entries.unionByName(asked).withColumn("__stretch", stretch(F.col("__at")))
    left = both.groupBy(*by, "__stretch").agg(F.max(F.when(F.col("__value").isNotNull(), F.struct("__at", "__nth", "__value"))).alias("__left"))
    earlier = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each key and stretch
    left = left.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__stretch").alias("__of"), F.last("__left.__value", True).over(earlier).alias("__before"))
    so_far = Window.partitionBy(*by, "__stretch").orderBy("__at", F.col("__row").isNotNull(), "__nth", "__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("__own", F.last("__value", True).over(so_far)).where(F.col("__row").isNotNull())
    same = [F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)]
    found = own.join(left, [*same, F.col("__stretch") == F.col("__of")], "left")
    return found.select("__row.*", F.when(F.col("__at").isNotNull(), F.coalesce("__own", "__before")).alias(value))
