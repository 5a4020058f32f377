"""Several raters: one gold label per item, and how well raters agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import binomial_two_sided, kappa, rate
from ..functions.verdicts import CATEGORIES
from .calibration import by_judge, confusion, matched, metrics, refuse, resolved

SCREEN_ALPHA, SCREEN_MIN_N = 0.05, 5
ITEM = ["probe", "item_id"]


def _table(x: str, y: str):
    return [[F.count_if((F.col(x) == j) & (F.col(y) == h)).alias(f"{j}_{h}".lower()) for h in CATEGORIES] for j in CATEGORIES]


def _kappas(grouped) -> DataFrame:
    """n, po, pe and kappa of grouped pairs (x, y) of labels."""
    cells = _table("x", "y")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), *[c for row in cells for c in row])
    names = [[f"{j}_{h}".lower() for h in CATEGORIES] for j in CATEGORIES]
    return out.withColumns(kappa([[F.col(c) for c in row] for row in names])).drop(*[c for row in names for c in row])


def gold_labels(labels: DataFrame) -> DataFrame:
    """The label most raters gave; of equals, the one of the highest summed confidence; of equals again, TIE and unresolved.

    agreement is the share of raters who gave the gold label.
    """
    counts = labels.groupBy(*ITEM, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"))
    item = Window.partitionBy(*ITEM)
    counts = counts.withColumns({"top": F.max("n").over(item), "n_labelers": F.sum("n").over(item)})
    leads = F.col("n") == F.col("top")
    counts = counts.withColumn("best", F.max(F.when(leads, F.col("confidence"))).over(item))
    heads = leads & (F.col("confidence") == F.col("best"))
    out = counts.groupBy(*ITEM).agg(
        F.max("n_labelers").alias("n_labelers"), F.count_if(leads).alias("leaders"), F.count_if(heads).alias("heads"), F.min(F.when(heads, F.col("label"))).alias("head"),
        F.max("top").alias("top"), F.coalesce(F.max(F.when(F.col("label") == "TIE", F.col("n"))), F.lit(0)).alias("ties"),
    )
    unresolved = (F.col("leaders") > 1) & (F.col("heads") > 1)
    return out.select(
        *ITEM, F.when(unresolved, "TIE").otherwise(F.col("head")).alias("gold"), "n_labelers",
        rate(F.when(unresolved, F.col("ties")).otherwise(F.col("top")), "n_labelers").alias("agreement"),
        ((F.col("leaders") > 1) & (F.col("heads") == 1)).alias("tie_broken"), unresolved.alias("unresolved"),
    )


def fleiss_kappa(labels: DataFrame) -> DataFrame:
    """kappa and n_items over items of two raters or more, whose number may vary; (0, 0) without any."""
    n = [F.count_if(F.col("label") == c).alias(c.lower()) for c in CATEGORIES]
    items = labels.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n"), *n).where("n >= 2")
    same = sum((F.col(c.lower()) * (F.col(c.lower()) - 1) for c in CATEGORIES), F.lit(0))
    out = items.withColumn("p", same / (F.col("n") * (F.col("n") - 1))).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("p").alias("p"), F.sum("n").alias("n"), *[F.sum(c.lower()).alias(c.lower()) for c in CATEGORIES]
    )
    bar, chance = F.col("p") / F.col("n_items"), sum((F.col(c.lower()) / F.col("n") * (F.col(c.lower()) / F.col("n")) for c in CATEGORIES), F.lit(0.0))
    one = sum((F.when(F.col(c.lower()) == F.col("n"), 1).otherwise(0) for c in CATEGORIES), F.lit(0)) == 1
    k = F.when(F.col("n_items") == 0, 0.0).when(one, F.when(bar == 1.0, 1.0).otherwise(0.0)).otherwise((bar - chance) / (1 - chance))
    return out.select(k.alias("kappa"), "n_items")


def pairwise_cohen(labels: DataFrame) -> DataFrame:
    """pair (both ids, joined by a bar), n, po, pe and kappa of each two raters over the items both labelled."""
    x, y = (labels.select(*ITEM, F.col("labeler_id").alias(f"id_{s}"), F.col("label").alias(s)) for s in "xy")
    both = x.join(y, ITEM).where("id_x < id_y")
    return _kappas(both.groupBy(F.concat_ws("|", "id_x", "id_y").alias("pair")))


def labeler_vs_gold(labels: DataFrame, gold: DataFrame) -> DataFrame:
    """n, po (the agreement), pe and kappa of each rater against the gold labels."""
    both = labels.select(*ITEM, "labeler_id", F.col("label").alias("x")).join(gold.select(*ITEM, F.col("gold").alias("y")), ITEM)
    return _kappas(both.groupBy("labeler_id"))


def position_screen(labels: DataFrame) -> DataFrame:
    """Raters who pick A too often or too seldom: n, n_a, a_rate, p_value and flagged, per rater and probe, over their A and B labels and ties alike.

    In the order of a review: flagged ones first, then by p.
    """
    counts = labels.groupBy("labeler_id", "probe").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "A").alias("n_a"))
    out = counts.withColumns({"p_value": binomial_two_sided("n_a", "n"), "a_rate": rate("n_a", "n")})
    out = out.withColumn("flagged", (F.col("p_value") < SCREEN_ALPHA) & (F.col("n") >= SCREEN_MIN_N))
    return out.orderBy(F.desc("flagged"), "p_value", "labeler_id", "probe")


def calibrate_gold(labels: DataFrame, verdicts: DataFrame, judge_id: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """metrics per judge and probe, of the verdicts against the gold labels."""
    gold = gold_labels(refuse(resolved(labels, known), judge_id)).withColumnRenamed("gold", "label")
    return metrics(confusion(matched(gold, verdicts).where("verdict IS NOT NULL")))


def coverage(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """For each judge in verdicts, in all (probe null) and by probe: n_items and n_unresolved of items it has a verdict on, and n_unmatched: votes on items without."""
    gold = gold_labels(labels)
    total = gold.groupBy("probe").agg(F.sum("n_labelers").alias("n"))
    both = gold.join(verdicts.select("judge", *ITEM).distinct(), ITEM).groupBy("judge", "probe")
    sums = {"n_items": F.count(F.lit(1)), "n_unresolved": F.count_if("unresolved"), "votes": F.sum("n_labelers")}
    found = by_judge(both.agg(*[v.alias(k) for k, v in sums.items()]), total, verdicts, list(sums))
    return found.select("judge", "probe", "n_items", "n_unresolved", (F.col("n") - F.col("votes")).alias("n_unmatched"))
