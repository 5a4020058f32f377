"""What a battery can see, and how often it alarms for nothing: exact, from the distributions of counts, without simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import binomial_pmf, binomial_sf, critical_value, fisher_exact
from .battery import ALPHA, MIN_N
from .drift import ALPHA as DRIFT_ALPHA
from .drift import MIN_SHIFT

#: Terms of a count's distribution further from its mean are left out: twelve standard deviations, and 40 events at least.
DEVIATIONS, LEAST = 12, 40


def power(counts: DataFrame, rates: list[float], n: str = "n_valid", alpha: float = ALPHA, min_n: int = MIN_N) -> DataFrame:
    """counts with critical (the least number of events that trips) and, for each true rate of the event, the probability of a trip."""
    out = counts.withColumn("critical", critical_value(n, alpha)).withColumn("true_rate", F.explode(F.array(*map(F.lit, rates))))
    return out.withColumn("power", F.when(F.col(n) < min_n, 0.0).otherwise(binomial_sf("critical", n, F.col("true_rate"))))


def _pmf(k: Column, n: Column, p: Column) -> Column:
    """Also for p of 0 and 1."""
    k, n = k.cast("double"), n.cast("double")
    inside = binomial_pmf(k, n, F.when((p > 0) & (p < 1), p).otherwise(0.5))
    return F.when(p <= 0, (k == 0).cast("double")).when(p >= 1, (k == n).cast("double")).otherwise(inside)


def _near(n: Column, p: Column) -> Column:
    """The numbers of events of n trials that can matter."""
    mean, room = n * p, DEVIATIONS * F.sqrt(n * p * (1 - p)) + LEAST
    return F.sequence(F.greatest(F.lit(0), F.floor(mean - room)).cast("long"), F.least(n, F.ceil(mean + room)).cast("long"))


def resampled(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, probe, n_valid, events, again, p): the number of events when other items are drawn, at the rate that was seen."""
    rate = F.when(F.col("n_valid") > 0, F.col("events") / F.col("n_valid")).otherwise(0.0)
    rows = counts.select(*by, "probe", "n_valid", "events", rate.alias("rate")).withColumn("again", F.explode(_near(F.col("n_valid"), F.col("rate"))))
    return rows.withColumn("p", _pmf(F.col("again"), F.col("n_valid"), F.col("rate"))).drop("rate")


def sticky(counts: DataFrame, by: list[str], flips: float) -> DataFrame:
    """The same when the items stay, and each verdict flips with this probability: those that were events and those that were not, convolved."""
    q = F.lit(flips)
    rows = counts.select(*by, "probe", "n_valid", "events").withColumn("lost", F.explode(_near(F.col("events"), q)))
    rows = rows.withColumn("won", F.explode(_near(F.col("n_valid") - F.col("events"), q)))
    p = _pmf(F.col("lost"), F.col("events"), q) * _pmf(F.col("won"), F.col("n_valid") - F.col("events"), q)
    return rows.groupBy(*by, "probe", "n_valid", "events", (F.col("events") - F.col("lost") + F.col("won")).alias("again")).agg(F.sum(p).alias("p"))


def flips(outcomes: DataFrame, by: list[str], alpha: float = ALPHA, min_n: int = MIN_N) -> DataFrame:
    """(by, probe, p_flip): how likely the next snapshot is on the other side of the bar."""
    critical = outcomes.select("n_valid").distinct().withColumn("critical", critical_value("n_valid", alpha))
    rows = outcomes.join(critical, "n_valid")
    flip = (F.col("n_valid") >= min_n) & ((F.col("again") >= F.col("critical")) != (F.col("events") >= F.col("critical")))
    return rows.groupBy(*by, "probe").agg(F.sum(F.when(flip, F.col("p")).otherwise(0.0)).alias("p_flip"))


def family_alarms(outcomes: DataFrame, by: list[str], probes: list[str], alpha: float = ALPHA, min_n: int = MIN_N) -> DataFrame:
    """(by, p_flip, p_alert): how likely some probe of a comparison flips, and how likely any alert is, with Holm's step-down over all of them.

    Holm's steps have the bars alpha / m, ..., alpha / 1. A test's level is the first bar that its p reaches. If K is the last number for which at least k
    tests have a level up to k, for all k up to K, the tests with levels up to K are rejected. So an alert hangs on how many tests have each level, and on
    the least level of a test whose shift is large enough; these are convolved probe by probe (`probes`: all names; a battery's are few), for all
    comparisons at once. Comparisons lack what they lack.
    """
    m = F.col("tests")
    sizes = outcomes.groupBy(*by).agg(F.count_distinct("probe").alias("tests"))
    pairs = outcomes.select("n_valid", "events", "again").distinct()
    n, k = F.col("n_valid"), F.col("events")
    tested = pairs.withColumns({"fisher_p": fisher_exact(k, n - k, F.col("again"), n - F.col("again")), "critical": critical_value(n, alpha)})
    rows = outcomes.join(tested, ["n_valid", "events", "again"]).join(sizes, by)
    decided, moved = n >= min_n, F.abs(F.col("again") - k) >= MIN_SHIFT * n
    flip = decided & ((F.col("again") >= F.col("critical")) != (k >= F.col("critical")))
    level = F.greatest(F.lit(1), F.ceil(m + 1 - DRIFT_ALPHA / F.greatest("fisher_p", F.lit(1e-300)))).cast("int")
    level = F.when(F.col("fisher_p") <= DRIFT_ALPHA, level).otherwise(0)  # 0: reaches no bar
    rows = rows.select(*by, "probe", "p", "tests", flip.alias("flip"), level.alias("level"), F.when(decided & moved & (level > 0), level).alias("large"))
    steps = rows.groupBy(*by, "probe", "tests", "flip", "level", "large").agg(F.sum("p").alias("p"))
    none = F.transform(F.sequence(F.lit(1), m), lambda _: F.lit(0))
    state = sizes.select(*by, "tests", none.alias("at"), F.lit(None).cast("int").alias("least"), F.lit(False).alias("flipped"), F.lit(1.0).alias("w"))
    for probe in probes:
        own = steps.where(F.col("probe") == probe).drop("probe", "tests")
        both = state.join(own, by, "left")
        at = F.when(F.col("level") > 0, F.transform("at", lambda c, i: c + (i + 1 == F.col("level")).cast("int"))).otherwise(F.col("at"))
        both = both.select(*by, "tests", at.alias("at"), F.least("least", "large").alias("least"), (F.col("flipped") | F.coalesce("flip", F.lit(False))).alias("flipped"), (F.col("w") * F.coalesce("p", F.lit(1.0))).alias("w"))
        state = both.groupBy(*by, "tests", "at", "least", "flipped").agg(F.sum("w").alias("w"))
    # the last K: sums of counts so far stay at or over their number
    walk = F.aggregate("at", F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"), F.lit(0).alias("last"), F.lit(True).alias("go")), lambda s, c: F.struct(
        (s["i"] + 1).alias("i"), (s["sum"] + c).alias("sum"), F.when(s["go"] & (s["sum"] + c >= s["i"] + 1), s["i"] + 1).otherwise(s["last"]).alias("last"), (s["go"] & (s["sum"] + c >= s["i"] + 1)).alias("go")), lambda s: s["last"])
    alert = F.col("flipped") | F.coalesce(F.col("least") <= walk, F.lit(False))
    return state.groupBy(*by).agg(F.sum(F.when(F.col("flipped"), F.col("w")).otherwise(0.0)).alias("p_flip"), F.sum(F.when(alert, F.col("w")).otherwise(0.0)).alias("p_alert"))
