"""Commands over files: python -m tribunal.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.verdicts import parse_verdict
from .operators import adjudication, battery, calibration, drift, judges, probes, rescoring
from .plans import protocols, reports
from .plans.banks import PROBES, bars_of, discover, entries_of, load_banks
from .sources import http, labels
from .sources.ledger import Ledger


def _items(spark, a):
    known = discover(a.definitions) if a.definitions else {}
    names = a.probes.split(",") if a.probes else list(known or PROBES)
    if unknown := [n for n in names if n not in (known or PROBES)]:
        raise SystemExit(f"unknown probes: {', '.join(unknown)}")
    given = {k: entries_of(known[k]) for k in names} if known else load_banks(a.banks) if a.banks else None
    specs = probes.specs_of({k: known[k] for k in names}) if known else probes.SPECS
    entries = probes.bank_frame(spark, names, given)
    if (bad := probes.broken_guards(entries, specs).first()) is not None:
        raise SystemExit(f"{bad.probe}, entry {bad.bank_idx}: {bad.broken}")
    if (bad := probes.unbalanced(entries, specs).first()) is not None:
        raise SystemExit(f"{bad.probe}: the biased side is the longer one in {bad.n_longer} of {bad.n} entries")
    if a.n is None and getattr(a, "replay", None):
        a.n, left = divmod(labels.read_replay(spark, *a.replay).count(), len(names))
        if left:
            raise SystemExit("the recorded prompts don't divide evenly among the probes")
    a.n = 30 if a.n is None else a.n
    return probes.generate_items(entries, a.n, a.seed, a.policy, specs=specs)


def _verdicts(spark, a):
    items = _items(spark, a)
    if a.replay:
        recorded = labels.read_replay(spark, *a.replay).select("prompt_key", F.col("verdict").alias("raw"))
        asked = items.withColumn("prompt_key", F.sha2(F.concat_ws("\0", F.lit(probes.SYSTEM), probes.prompt()), 256))
        judged = asked.join(recorded, "prompt_key").withColumn("judge", F.lit(a.judge))
    elif a.judge in judges.NAMES:
        judged = judges.judged(items, (a.judge,))
    else:
        make = {
            "chat": lambda: http.chat_completions(a.url, a.judge, a.key), "local": lambda: http.chat_completions(a.url or http.LOCAL, a.judge, a.key), "messages": lambda: http.messages(a.url, a.judge, a.key),
            "custom": lambda: http.custom(a.url, Path(a.template).read_text(), a.reply, a.header, model=a.judge),
        }
        prompts = items.withColumns({"system": F.lit(probes.SYSTEM), "user": probes.prompt()})
        if a.log:
            replied = http.asked_once(prompts, make[a.interface](), a.log).drop("system", "user")
        else:
            replied = items.join(http.asked(prompts.select("item_id", "system", "user"), make[a.interface]()), "item_id")
        judged = replied.withColumn("judge", F.lit(a.judge))
    return judged.withColumn("verdict", parse_verdict("raw"))


def _versions(a) -> dict[str, str]:
    known = {k: d["version"] for k, d in discover(a.definitions).items()} if a.definitions else {p: "1.0.0" for p in PROBES}
    return {p: known[p] for p in (a.probes.split(",") if a.probes else known)}


def _run(spark, a):
    verdicts = _verdicts(spark, a).persist()
    version = F.create_map(*[F.lit(x) for kv in _versions(a).items() for x in kv])
    results = battery.probe_results(battery.probe_counts(verdicts))
    results = reports.described(results.withColumns({"seed": F.lit(a.seed), "alpha": F.lit(battery.ALPHA), "min_n": F.lit(battery.MIN_N), "version": F.element_at(version, F.col("probe"))}))
    return verdicts, battery.with_reasons(results).persist()


def list_probes(spark, a):
    print("\n".join(sorted(PROBES)))


def run(spark, a):
    verdicts, results = _run(spark, a)
    try:
        Path(a.out).write_text(reports.reports(results, verdicts).first().report)
        print(reports.markdown(results, a.judge))
        return 0 if battery.grades(results).first().grade == "PASS" else 1
    finally:
        results.unpersist()
        verdicts.unpersist()


def protocol_freeze(spark, a):
    bars = bars_of(discover(a.definitions)) if a.definitions else None
    print(protocols.freeze(a.out, probes=_versions(a), n=a.n or 30, seed=a.seed, bars=bars)["sha256"])


def protocol_verify(spark, a):
    report = spark.read.schema(labels.REPORT).json(a.report, multiLine=True).select(F.explode("probes").alias("p")).select("p.*")
    protocols.verify(protocols.load(a.protocol), report, a.labels)
    print("as frozen")


def _calibrate(spark, a, many):
    given, report = labels.read_labels(spark, a.labels), labels.read_report(spark, a.report)
    sha = protocols.load(a.protocol)["sha256"] if a.protocol else None
    bundle = (reports.calibrated_by_several if many else reports.calibrated)(given, report, a.judge, sha)
    Path(a.out).write_text(json.dumps(bundle, indent=2))
    if a.copy:
        Path(a.copy).write_text(reports.with_calibration(Path(a.report).read_text(), bundle))
    if many and a.gold:
        adjudication.gold_labels(calibration.resolved(given)).write.json(a.gold)


def export_labeling_set(spark, a):
    sealed = rescoring.blinded(_items(spark, a), a.seed, "labeling", swap=False)
    sealed.select("labeling_id", F.lit(probes.SYSTEM).alias("system"), probes.prompt().alias("user")).write.json(f"{a.out}/blinded")
    sealed.select("labeling_id", "probe", "item_id").write.json(f"{a.out}/sealed")


def import_labels(spark, a):
    sealed = spark.read.schema("labeling_id string, probe string, item_id string").json(a.sealed)
    replies = spark.read.schema("labeling_id string, label string, confidence int").json(a.replies)
    rescoring.refuse_gaps(sealed.join(replies, "labeling_id", "left_semi"), replies, "labeling_id")
    if not replies.where(~F.coalesce(F.col("label").isin("A", "B", "TIE"), F.lit(False))).isEmpty():
        raise SystemExit("a label isn't A, B or TIE")
    out = replies.join(sealed, "labeling_id").select("probe", "item_id", "label", F.coalesce("confidence", F.lit(2)).alias("confidence"), F.lit(a.labeler).alias("labeler_id"), F.lit(a.ts).alias("timestamp"))
    out.write.json(a.out)


def drift_snapshot(spark, a):
    verdicts, results = _run(spark, a)
    known = discover(a.definitions) if a.definitions else {}
    sha = protocols.build(_versions(a), a.n, 0, bars=bars_of(known))["sha256"]  # the seed of a run is the snapshot's
    if known:
        sha = protocols.identity(sha, {k: known[k]["file_sha256"] for k in _versions(a)})
    print(Ledger(spark, a.ledger).append(results, ts=a.ts, judge=a.judge, protocol_sha256=sha, seed=a.seed, n=a.n, grade=battery.grades(results).first().grade))
    results.unpersist()
    verdicts.unpersist()


def drift_baseline(spark, a):
    Ledger(spark, a.ledger).pin(a.id, ts=a.ts, reason=a.reason)


def drift_report(spark, a):
    book = Ledger(spark, a.ledger)
    broken = book.verify()
    if broken:
        print(f"the chain is broken at {broken}", file=sys.stderr)
    first, last = book.choose(a.since, a.baseline, a.target)
    rows, seeds = drift.compare_snapshots(book.snapshot(first), book.snapshot(last))
    if seeds:
        print("the seeds differ, and so do the items", file=sys.stderr)
    rows = rows.orderBy("probe").collect()
    for r in rows:
        print(r.probe, r.status, "" if r.delta is None else f"{r.rate_a:.3f} -> {r.rate_b:.3f}", r.alert_reason or r.watch_reason)
    return int(bool(broken) or any(r.alert for r in rows))


def drift_history(spark, a):
    """Each snapshot against what was its judge's baseline at its time."""
    for r in Ledger(spark, a.ledger).history().where("alert OR watch").orderBy("id", "probe").collect():  # what a reader has to look at
        print(f"{r.ts} {r.judge}: {r.id} against {r.baseline_id}, {r.probe}: {r.rate_a:.3f} -> {r.rate_b:.3f}, {'ALERT' if r.alert else 'watch'} {r.alert_reason or r.watch_reason}")


def main(argv=None) -> int:
    top = argparse.ArgumentParser(prog="tribunal")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run_, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run_)
        for o, kw in options:
            p.add_argument(o, **kw)
        return p

    out, ts, ledger = ("--out", {"required": True}), ("--ts", {"required": True}), ("--ledger", {"required": True})
    made = [("--probes", {"default": ""}), ("--banks", {"default": ""}), ("--definitions", {"default": "", "help": "a folder of definition files"}), ("--n", {"type": int, "default": None}), ("--seed", {"type": int, "default": 0}), ("--policy", {"choices": ["hash", "python"], "default": "hash"})]
    judged = [*made, ("--judge", {"required": True}), ("--interface", {"choices": ["chat", "local", "messages", "custom"], "default": "chat"}), ("--url", {"default": ""}), ("--key", {"default": ""}),
        ("--template", {"default": "", "help": "a file with the body of a custom judge"}), ("--reply", {"default": "", "help": "where its reply has the text"}), ("--header", {"action": "append", "default": []}), ("--log", {"default": "", "help": "a folder of replies, so that nothing is asked twice"}), ("--replay", {"nargs": 2, "metavar": ("BLINDED", "VERDICTS"), "default": None})]
    scored = [("--labels", {"nargs": "+", "required": True}), ("--report", {"required": True}), ("--judge", {"required": True}), ("--protocol", {"default": ""}), ("--copy", {"default": "", "help": "a copy of the report with the calibration"}), ("--gold", {"default": ""}), out]
    command("list-probes", list_probes)
    command("run", run, *judged, out)
    command("protocol-freeze", protocol_freeze, made[0], *made[2:5], out)
    command("protocol-verify", protocol_verify, ("--protocol", {"required": True}), ("--report", {"required": True}), ("--labels", {"nargs": "*", "default": []}))
    command("calibrate", lambda s, a: _calibrate(s, a, False), *scored)
    command("calibrate-multi", lambda s, a: _calibrate(s, a, True), *scored)
    command("export-labeling-set", export_labeling_set, *made, out)
    command("import-labels", import_labels, ("--sealed", {"required": True}), ("--replies", {"required": True}), ("--labeler", {"required": True}), ts, out)
    command("drift-snapshot", drift_snapshot, *judged, ledger, ts)
    command("drift-import-chat", drift_snapshot, *judged, ledger, ts)
    command("drift-baseline", drift_baseline, ledger, ("--id", {"type": int, "required": True}), ts, ("--reason", {"default": ""}))
    command("drift-report", drift_report, ledger, ("--since", {"default": None}), ("--baseline", {"type": int}), ("--target", {"type": int}))
    command("drift-history", drift_history, ledger)
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("tribunal").getOrCreate()
    return a.run(spark, a) or 0


if __name__ == "__main__":
    sys.exit(main())
