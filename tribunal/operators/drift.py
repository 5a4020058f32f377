"""Snapshots compared: Fisher tests per probe, Holm's step-down over a comparison, alerts and watches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import fisher_exact, rate

ALPHA, MIN_SHIFT, WATCH_SHIFT = 0.05, 0.15, 0.075


def holm(tests: DataFrame, by: list[str], p: str = "fisher_p", order: str = "probe", alpha: float = ALPHA) -> DataFrame:
    """Adds holm_significant: in ascending p, rejected as long as p <= alpha / (tests left)."""
    within = Window.partitionBy(*by)
    ranked = within.orderBy(p, order)
    out = tests.withColumns({"__rank": F.row_number().over(ranked), "__tests": F.count(F.lit(1)).over(within)})
    passes = F.col(p) <= F.lit(alpha) / (F.col("__tests") - F.col("__rank") + 1)
    out = out.withColumn("holm_significant", F.min(passes).over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.drop("__rank", "__tests")


def compare(a: DataFrame, b: DataFrame, by: list[str], alpha: float = ALPHA, on: list[str] = ()) -> DataFrame:
    """Probe rows a (probe, n_valid, events, tripped, inconclusive) against the target's rows b, for each comparison (the columns `by` of b).

    on: the columns among `by` that a has, too, where comparisons have baselines of their own. status is compared, inconclusive-involved, or absent-in-b; a
    probe only in b isn't compared. Inconclusive probes still count among the tests.
    """
    on = list(on)
    x = a.select(*on, "probe", *[F.col(c).alias(f"{c}_a") for c in ("n_valid", "events", "tripped", "inconclusive")])
    y = b.select(*by, "probe", *[F.col(c).alias(f"{c}_b") for c in ("n_valid", "events", "tripped", "inconclusive")])
    found = y.join(x, [*on, "probe"])
    cells = [F.col("events_a"), F.col("n_valid_a") - F.col("events_a"), F.col("events_b"), F.col("n_valid_b") - F.col("events_b")]
    found = holm(found.withColumns({"rate_a": rate("events_a", "n_valid_a"), "rate_b": rate("events_b", "n_valid_b"), "fisher_p": fisher_exact(*cells)}), by, alpha=alpha)
    found = found.withColumn("delta", F.col("rate_b") - F.col("rate_a"))
    open_ = F.col("inconclusive_a") | F.col("inconclusive_b")
    found = found.withColumns({"status": F.when(open_, "inconclusive-involved").otherwise("compared"), "trip_flip": ~open_ & (F.col("tripped_a") != F.col("tripped_b"))})
    shift = ~open_ & F.col("holm_significant") & (F.abs("delta") >= MIN_SHIFT)
    found = found.withColumn("alert", F.col("trip_flip") | shift)
    watch = ~F.col("alert") & ~open_ & (F.abs("delta") >= WATCH_SHIFT)
    found = found.withColumns({
        "alert_reason": F.concat_ws("; ", F.when(F.col("trip_flip"), "trip_flip"), F.when(shift, "rate_shift")),
        "watch": watch, "watch_reason": F.when(watch, F.when(F.col("holm_significant"), "sub-gate shift").otherwise("near-bar shift")).otherwise(""),
    })
    shown = ["rate_a", "rate_b", "delta", "fisher_p", "holm_significant", "trip_flip", "alert", "alert_reason", "watch", "watch_reason", "status"]
    seen = y.groupBy(*by).agg(F.collect_set("probe").alias("seen"))  # probes of a battery are few
    if on:
        seen = seen.join(x.groupBy(*on).agg(F.collect_set("probe").alias("names")), on)
    else:
        seen = seen.withColumn("names", x.agg(F.collect_set("probe")).scalar())
    absent = seen.select(*by, F.explode(F.array_except("names", "seen")).alias("probe"))
    gone = absent.select(*by, "probe", *[
        F.lit(None).cast("double").alias(c) if c in shown[:4] else F.lit("absent-in-b" if c == "status" else "").alias(c) if c in ("status", "alert_reason", "watch_reason") else F.lit(False).alias(c) for c in shown
    ])
    return found.select(*by, "probe", *shown).unionByName(gone)


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """n_compared, n_alerts, alerting, n_trip_flips, n_watch and watching (sorted names) of each comparison."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c), F.col("probe").cast("string")))), ",")
    return rows.groupBy(*by).agg(
        F.count_if(F.col("status") != "absent-in-b").alias("n_compared"), F.count_if("alert").alias("n_alerts"), names("alert").alias("alerting"),
        F.count_if("trip_flip").alias("n_trip_flips"), F.count_if("watch").alias("n_watch"), names("watch").alias("watching"),
    )


class ProtocolsDiffer(ValueError):
    """Snapshots of different protocols are not compared."""


def compare_snapshots(a: DataFrame, b: DataFrame) -> tuple[DataFrame, bool]:
    """Two single snapshots of the ledger (with protocol_sha256, seed and probes): their rows, and whether the seeds differ (a warning)."""
    x, y = (s.select("protocol_sha256", "seed").first() for s in (a, b))
    if x.protocol_sha256 != y.protocol_sha256:
        raise ProtocolsDiffer(f"snapshots of different protocols: {x.protocol_sha256} and {y.protocol_sha256}")
    rows = [s.select(F.explode("probes").alias("p")).select("p.*") for s in (a, b)]
    return compare(*rows, by=[]), x.seed != y.seed
