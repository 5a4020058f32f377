"""Blinded second verdicts: sets with some answers swapped, and how often a judge agrees with itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clopper_pearson, rate
from ..functions.verdicts import unswap
from .calibration import Refused


def blinded(items: DataFrame, seed: int, prefix: str = "rescore", swap: bool = True) -> DataFrame:
    """items with `<prefix>_id` in an order drawn by seed, and swapped answers for about half: all but the id and the prompt belong in the sealed map.

    The draw is a hash of seed, probe and item, so it doesn't depend on partitions. Numbers come from ranges of the draw: each range is numbered by
    itself, after the counts of those before it, so no task holds all rows.
    """
    draw = F.xxhash64(F.lit(seed), "probe", "item_id")
    rows = items.withColumns({"__draw": draw, "__part": F.shiftright(draw, 52), "swapped": (F.pmod(F.xxhash64(F.lit(seed + 1), "probe", "item_id"), F.lit(2)) == 0) if swap else F.lit(False)})
    counts = rows.groupBy("__part").count()  # 4096 ranges at most
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("__draw", "probe", "item_id"))
    rows = rows.withColumn("__nth", nth).join(F.broadcast(before.select("__part", "__before")), "__part")
    a, b = F.col("answer_a"), F.col("answer_b")
    return rows.withColumns({
        f"{prefix}_id": F.format_string(f"{prefix}-%04d", F.col("__before") + F.col("__nth") - 1),
        "answer_a": F.when(F.col("swapped"), b).otherwise(a), "answer_b": F.when(F.col("swapped"), a).otherwise(b),
    }).drop("__draw", "__part", "__before", "__nth")


def refuse_gaps(sealed: DataFrame, verdicts: DataFrame, key: str = "rescore_id") -> None:
    """Verdicts must be one for each sealed id, and for no other."""
    if (bad := verdicts.join(sealed, key, "left_anti").select(F.min(key)).first()[0]) is not None:
        raise Refused(f"unknown {key} {bad!r}")
    if (bad := sealed.join(verdicts, key, "left_anti").select(F.min(key)).first()[0]) is not None:
        raise Refused(f"no verdict for {key} {bad!r}")
    if (bad := verdicts.groupBy(key).count().where("count > 1").select(F.min(key)).first()[0]) is not None:
        raise Refused(f"several verdicts for {key} {bad!r}")


def self_consistency(second: DataFrame, first: DataFrame) -> DataFrame:
    """n, n_same, consistency and its interval of each judge, by probe and over all (probe null); without the judge where neither table has it.

    second: judge, probe, item_id, swapped, verdict; first: judge, probe, item_id, verdict. Invalid second verdicts are left out; an invalid first one never
    agrees. Second verdicts must be on items that the judge had before (refuse_unscored).
    """
    judge = [c for c in ("judge",) if c in second.columns]
    if judge != [c for c in ("judge",) if c in first.columns]:
        raise Refused("both tables need a judge, or none")
    both = second.where("verdict <> 'INVALID'").join(first.select(*judge, "probe", "item_id", F.col("verdict").alias("before")), [*judge, "probe", "item_id"])
    both = both.withColumn("same", unswap("verdict", "swapped") == F.col("before"))
    sets = [[F.col(c) for c in (*judge, "probe")], [F.col(c) for c in judge]]
    out = both.groupingSets(sets, *judge, "probe").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_same"))
    low, high = clopper_pearson("n_same", "n")
    return out.withColumns({"consistency": rate("n_same", "n"), "low": low, "high": high})


def refuse_unscored(second: DataFrame, first: DataFrame) -> DataFrame:
    """Each second verdict must have one before it: of the same judge, on the same item."""
    key = [c for c in ("judge", "probe", "item_id") if c in second.columns]
    if (bad := second.join(first, key, "left_anti").select(*key).orderBy(*key).first()) is not None:
        raise Refused(f"no verdict before the second one on {'/'.join(map(str, bad))}")
    return second
