"""Run reports: one JSON document per judge, with calibrations where there are any, and Markdown for a reader."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adjudication, calibration
from ..operators.battery import grades
from .banks import DIRECTION_OF, PROBES
from .protocols import SCHEMA, TIES

TOOL, ADJUDICATION = "tribunal", "adjudication-v1"


def described(results: DataFrame) -> DataFrame:
    """results with expected_direction and two_sided, where they lack them."""
    known = F.create_map(*[F.lit(x) for p, e in PROBES.items() for x in (p, DIRECTION_OF[e])])
    more = {"expected_direction": F.element_at(known, F.col("probe")), "two_sided": F.lit(False)}
    return results.withColumns({k: v for k, v in more.items() if k not in results.columns})


def reports(results: DataFrame, verdicts: DataFrame | None = None, generated_at: str | None = None) -> DataFrame:
    """judge and report (JSON) per judge: grade, counts, and probes by name, with verdicts (without raw texts) where given."""
    rows = described(results).withColumn("rate", F.round("rate", 4))
    if verdicts is not None:
        listed = verdicts.groupBy("judge", "probe").agg(F.array_sort(F.collect_list(F.struct("item_id", "verdict"))).alias("verdicts"))
        rows = rows.join(listed, ["judge", "probe"], "left")
    fields = [c for c in rows.columns if c not in ("judge", "probe")]
    probes = rows.groupBy("judge").agg(F.array_sort(F.collect_list(F.struct("probe", *fields))).alias("probes"))
    both = probes.join(grades(results), "judge")
    at = generated_at or datetime.now(timezone.utc).isoformat()
    body = F.struct(F.lit(TOOL).alias("tool"), F.col("judge").alias("adapter"), F.col("judge").alias("judge_id"), F.lit(at).alias("generated_at"), "grade", "n_probes", "n_tripped", "probes")
    return both.select("judge", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def write_reports(df: DataFrame, path: str) -> None:
    """One line of JSON per judge."""
    df.select("report").write.text(path)


def _per_probe(metrics: DataFrame) -> dict[str, dict]:
    out = {}
    for r in metrics.orderBy("probe").collect():  # one row per probe
        d = r.asDict()
        d |= {"tpr_ci": [d.pop("tpr_low"), d.pop("tpr_high")], "tnr_ci": [d.pop("tnr_low"), d.pop("tnr_high")]}
        out[d.pop("probe")] = {k: v for k, v in d.items() if k != "judge"}
    return out


def _raters(labels: DataFrame) -> list[str]:
    return sorted(r[0] for r in labels.select("labeler_id").distinct().collect())


def calibrated(labels: DataFrame, verdicts: DataFrame, judge_id: str, protocol_sha256: str | None = None) -> dict:
    """What a report holds of a calibration: who labelled, how many labels there were, and the metrics by probe."""
    per_probe = _per_probe(calibration.calibrate(labels, verdicts, judge_id))
    n_labels = labels.count()
    counts = calibration.unmatched(calibration.resolved(labels), verdicts).where("probe IS NULL").first()  # a report is of one judge
    return {
        "protocol_sha256": protocol_sha256, "labeler_id": ",".join(_raters(labels)), "label_schema_version": SCHEMA, "tie_rule": TIES,
        "n_labels": n_labels, "n_unmatched": counts.n_unmatched if counts else n_labels, "per_probe": per_probe,
    }


def calibrated_by_several(labels: DataFrame, verdicts: DataFrame, judge_id: str, protocol_sha256: str | None = None) -> dict:
    """The same against the gold labels, with how well raters agree, and the screen in the order of its review. Items' gold labels stay a table (gold_labels)."""
    per_probe = _per_probe(adjudication.calibrate_gold(labels, verdicts, judge_id))
    own = calibration.resolved(labels)
    fleiss, n_labels = adjudication.fleiss_kappa(own).first(), labels.count()
    covered = adjudication.coverage(own, verdicts).where("probe IS NULL").first()
    n_unmatched, n_items, n_unresolved = (covered.n_unmatched, covered.n_items, covered.n_unresolved) if covered else (n_labels, 0, 0)
    by = lambda df, key: {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.orderBy(key).collect()}
    return {
        "protocol_sha256": protocol_sha256, "labeler_ids": _raters(labels), "label_schema_version": SCHEMA, "tie_rule": TIES, "adjudication_rule": ADJUDICATION,
        "n_labels": n_labels, "n_unmatched": n_unmatched, "n_items": n_items, "n_unresolved": n_unresolved, "per_probe": per_probe,
        "inter_rater": {"fleiss_kappa": fleiss.kappa, "fleiss_n_items": fleiss.n_items, "pairwise": by(adjudication.pairwise_cohen(own), "pair")},
        "labeler_vs_gold": by(adjudication.labeler_vs_gold(own, adjudication.gold_labels(own)), "labeler_id"), "position_flags": [r.asDict() for r in adjudication.position_screen(own).collect()],
    }


def with_calibration(report: str, bundle: dict) -> str:
    """A copy of a report (JSON) with a calibration."""
    return json.dumps(json.loads(report) | {"calibration": bundle}, indent=2)


def markdown(results: DataFrame, judge: str, bundle: dict | None = None) -> str:
    """A table of one judge's probes, which are few, and of its calibration."""
    rows = described(results).where(F.col("judge") == judge).orderBy("probe").collect()
    grade = grades(results.where(F.col("judge") == judge)).first()
    out = [f"# {judge}: {grade.grade if grade else 'INCONCLUSIVE'}", "", "| probe | valid | events | rate | p | direction | result |", "|-|-|-|-|-|-|-|"]
    for r in rows:
        result = "INCONCLUSIVE" if r.inconclusive else "TRIPPED" if r.tripped else "pass"
        out.append(f"| {r.probe} | {r.n_valid} | {r.events} | {r.rate:.4f} | {r.p_value:.4g} | {r.expected_direction or ''}{' (two-sided)' if r.two_sided else ''} | {result} |")
    return "\n".join([*out, "", "A probe with more than a quarter of its verdicts unreadable is inconclusive.", *(_calibration_table(bundle) if bundle else []), ""])


def _calibration_table(b: dict) -> list[str]:
    who = b.get("labeler_id") or ", ".join(b.get("labeler_ids", []))
    out = ["", "## Calibration", "", f"Protocol {b['protocol_sha256'] or 'none'}; labels by {who}: {b['n_labels']}, of which {b['n_unmatched']} without a verdict ({b['label_schema_version']}, {b['tie_rule']}).", ""]
    out += ["| probe | labels | TPR (95 %) | TNR (95 %) | kappa | Po | Pe |", "|-|-|-|-|-|-|-|"]
    share = lambda m, k: f"{m[k]:.3f} ({m[k + '_ci'][0]:.3f} to {m[k + '_ci'][1]:.3f})"
    out += [f"| {p} | {m['n_labeled']} | {share(m, 'tpr')} | {share(m, 'tnr')} | {m['kappa']:.3f} | {m['po']:.3f} | {m['pe']:.3f} |" for p, m in b["per_probe"].items()]
    return [*out, "", "A tie of the judge against a label of A or B is a miss; labels of TIE count for kappa only. Intervals are exact."]
