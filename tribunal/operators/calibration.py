"""Judge against human labels: confusion, TPR and TNR with exact intervals, Cohen's kappa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clopper_pearson, kappa, rate
from ..functions.verdicts import CATEGORIES, probe_of


class Refused(ValueError):
    """The labels can't be used as they are."""


def resolved(labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """labels with probe filled in from item_id where it is missing; an inferred probe must be known."""
    given = F.nullif(F.col("probe"), F.lit("")) if "probe" in labels.columns else F.lit(None).cast("string")
    out = labels.withColumns({"__given": given, "probe": F.coalesce(given, probe_of("item_id"))})
    if known is not None and (bad := out.where("__given IS NULL").join(known, "probe", "left_anti").select(F.min("item_id")).first()[0]) is not None:
        raise Refused(f"label for {bad!r}: its probe is unknown")
    return out.drop("__given")


def own_labels(labels: DataFrame, judge_id: str) -> DataFrame:
    """The labels given by the judge itself, whatever the case of its name."""
    return labels.where(F.lower("labeler_id") == judge_id.lower())


def duplicate_labels(labels: DataFrame) -> DataFrame:
    """probe, item_id, labeler_id and count of what was labelled more than once by one labeler."""
    return labels.groupBy("probe", "item_id", "labeler_id").count().where("count > 1")


def refuse_own_labels(labels: DataFrame, judge_id: str) -> DataFrame:
    """A judge must not have labelled what it is measured by."""
    return refuse(labels, judge_id, duplicates=False)


def refuse_duplicates(labels: DataFrame) -> DataFrame:
    return refuse(labels)


def refuse(labels: DataFrame, judge_id: str | None = None, duplicates: bool = True) -> DataFrame:
    """labels, unless the judge (if given) gave some of them or, with duplicates, someone labelled an item twice; both are looked for in one pass."""
    given = labels.groupBy("labeler_id", "probe", "item_id").agg(F.count(F.lit(1)).alias("n"))
    twice = F.min(F.when(F.col("n") > 1, F.struct("probe", "item_id", "labeler_id")))
    found = given.agg(F.bool_or(F.lower("labeler_id") == (judge_id or "").lower()).alias("own"), twice.alias("twice")).first()
    if judge_id and found.own:
        raise Refused(f"labels by the judge itself: {judge_id!r}")
    if duplicates and found.twice is not None:
        raise Refused(f"{found.twice.labeler_id!r} labelled {found.twice.probe}/{found.twice.item_id} more than once")
    return labels


def matched(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """labels (probe, item_id, label) with the judge's verdict, null where it has none."""
    return labels.join(verdicts.select("judge", "probe", "item_id", "verdict"), ["probe", "item_id"], "left")


def confusion(pairs: DataFrame, by=("judge", "probe")) -> DataFrame:
    """n_labeled, n_scored and the nine counts judge_human (a_b: judge A, human B); verdicts that aren't A, B or TIE are left out of these."""
    cell = lambda j, h: F.count_if((F.col("verdict") == j) & (F.col("label") == h)).alias(f"{j}_{h}".lower())
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_labeled"), F.count_if(F.col("verdict").isin(*CATEGORIES)).alias("n_scored"), *[cell(j, h) for j in CATEGORIES for h in CATEGORIES]
    )


def metrics(table: DataFrame) -> DataFrame:
    """Adds tp, fn, tn, fp (A against the rest; a tie of the judge is a miss), tpr, tnr, their intervals, po, pe and kappa."""
    c = lambda j, h: F.col(f"{j}_{h}".lower())
    out = table.withColumns({
        "tp": c("A", "A"), "fn": c("B", "A") + c("TIE", "A"),
        "tn": c("B", "B"), "fp": c("A", "B") + c("TIE", "B"),
    })
    out = out.withColumns({"tpr": rate("tp", F.col("tp") + F.col("fn")), "tnr": rate("tn", F.col("tn") + F.col("fp"))})
    bounds = {}
    for name, k, n in (("tpr", "tp", F.col("tp") + F.col("fn")), ("tnr", "tn", F.col("tn") + F.col("fp"))):
        bounds[f"{name}_low"], bounds[f"{name}_high"] = clopper_pearson(k, n)
    return out.withColumns(bounds).withColumns(kappa([[c(j, h) for h in CATEGORIES] for j in CATEGORIES]))


def calibrate(labels: DataFrame, verdicts: DataFrame, judge_id: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """metrics per judge and probe over all labelers' pairs; labels without a verdict are left out (see unmatched)."""
    labels = refuse(resolved(labels, known), judge_id)
    return metrics(confusion(matched(labels, verdicts).where("verdict IS NOT NULL")))


def unmatched(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """n_labels and n_unmatched (labels of items that the judge has no verdict on) of each judge in verdicts, in all (probe null) and by probe.

    Only what matches is joined: what doesn't is all labels less that, so labels aren't repeated for each judge.
    """
    total = labels.groupBy("probe").agg(F.count(F.lit(1)).alias("n"))
    found = labels.join(verdicts.select("judge", "probe", "item_id"), ["probe", "item_id"]).groupBy("judge", "probe").agg(F.count(F.lit(1)).alias("found"))
    return by_judge(found, total, verdicts, ["found"]).select("judge", "probe", F.col("n").alias("n_labels"), (F.col("n") - F.col("found")).alias("n_unmatched"))


def by_judge(found: DataFrame, total: DataFrame, verdicts: DataFrame, sums: list[str]) -> DataFrame:
    """n (of total, by probe) and the sums of found (by judge and probe; 0 where there is none) for each judge in verdicts, in all (probe null) and by probe of total."""
    probes = total.agg(F.collect_list(F.struct("probe", "n")).alias("probes"))  # a battery's probes are few
    judges = verdicts.select("judge").distinct().withColumn("all", F.coalesce(probes.scalar(), F.array().cast("array<struct<probe: string, n: bigint>>")))
    each = judges.select("judge", F.explode_outer("all").alias("p")).select("judge", "p.probe", F.coalesce("p.n", F.lit(0)).alias("n"))
    each = each.join(found, ["judge", "probe"], "left").na.fill(0, sums)
    sets = each.groupingSets([[F.col("judge"), F.col("probe")], [F.col("judge")]], "judge", "probe").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums], F.grouping("probe").alias("whole"))
    return sets.where("whole = 1 OR probe IS NOT NULL").drop("whole")
