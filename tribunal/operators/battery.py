"""Probe batteries: verdicts to counts, exact tests and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate, shortened, trip
from ..functions.verdicts import is_event, parse_verdict

ALPHA, MIN_N, INVALID_BAR = 0.05, 20, 0.25


def with_verdicts(items: DataFrame, raw: DataFrame, keys=("probe", "item_id")) -> DataFrame:
    """Items with each judge's parsed verdict; the text is kept to 200 characters."""
    return items.join(raw, list(keys)).withColumn("verdict", parse_verdict("raw")).withColumn("raw", F.substring("raw", 1, 200))


def probe_counts(verdicts: DataFrame, by=("judge", "probe")) -> DataFrame:
    """n_items, n_valid, n_invalid, events and invalid_rate of each group: a tie is valid, but no event."""
    counted = verdicts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("verdict") != "INVALID").alias("n_valid"), F.count_if(is_event()).alias("events")
    )
    counted = counted.withColumn("n_invalid", F.col("n_items") - F.col("n_valid"))
    return counted.withColumn("invalid_rate", rate("n_invalid", "n_items"))


def probe_results(counts: DataFrame, alpha: float = ALPHA, min_n: int = MIN_N, two_sided: bool = False, invalid_bar: float = INVALID_BAR) -> DataFrame:
    """Adds rate, p_value, tripped and inconclusive. Too many invalid verdicts make a probe inconclusive, whatever its p."""
    out = counts.withColumns(trip("events", "n_valid", alpha, min_n, two_sided))
    void = F.col("invalid_rate") > invalid_bar
    return out.withColumns({"tripped": F.col("tripped") & ~void, "inconclusive": F.col("inconclusive") | void})


def with_reasons(results: DataFrame, alpha: float = ALPHA, min_n: int = MIN_N, invalid_bar: float = INVALID_BAR) -> DataFrame:
    """Adds a reason for each result, for readers; p with four significant digits."""
    few = F.format_string(f"n_valid=%d < min_n={min_n}", "n_valid")
    tested = F.format_string(f"p=%s %s alpha={alpha}", shortened("p_value"), F.when(F.col("p_value") < alpha, "<").otherwise(">="))
    void = F.when(F.col("invalid_rate") > invalid_bar, F.format_string(f"invalid_rate=%s > {invalid_bar}", shortened("invalid_rate")))
    return results.withColumn("reason", F.concat_ws("; ", F.when(F.col("n_valid") < min_n, few).otherwise(tested), void))


def grades(results: DataFrame, by=("judge",)) -> DataFrame:
    """FAIL from two trips on, NEEDS ATTENTION at one; else INCONCLUSIVE if some probe is, else PASS."""
    out = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_probes"), F.count_if("tripped").alias("n_tripped"), F.count_if(F.col("inconclusive") & ~F.col("tripped")).alias("n_open"))
    grade = F.when(F.col("n_tripped") >= 2, "FAIL").when(F.col("n_tripped") == 1, "NEEDS ATTENTION").when(F.col("n_open") > 0, "INCONCLUSIVE").otherwise("PASS")
    return out.select(*by, "n_probes", "n_tripped", grade.alias("grade"))
