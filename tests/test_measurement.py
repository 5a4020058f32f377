import hashlib
import json
import math
import random
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tribunal.functions import stats
from tribunal.functions.verdicts import parse_verdict, probe_of, unswap
from tribunal.operators import adjudication, battery, calibration, drift, judges, probes, rescoring
from tribunal.plans import banks, protocols, reports
from tribunal.plans.banks import PROBES
from tribunal.sources import http, labels
from tribunal.sources.labels import BadRecord
from tribunal.operators.asof import as_of
from tribunal.sources.ledger import Ledger, Taken, record, verify_chain
from tribunal.streaming.verdicts import watch, windowed_counts


def comb_sf(k, n, p):
    return 1.0 if n <= 0 or k <= 0 else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def comb_cdf(k, n, p):
    return 1.0 if n <= 0 or k >= n else 0.0 if k < 0 else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def column(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).withColumns(columns).collect()


def test_binomial_tails(spark):
    rng = random.Random(0)
    cases = [(k, n, p) for n in (0, 1, 2, 10, 30) for k in range(-1, n + 2) for p in (0.5, 0.3)] + [(rng.randrange(n + 1), n, 0.5) for n in (100, 700, 1000) for _ in range(12)]
    got = column(spark, cases, "k long, n long, p double", sf=stats.binomial_sf("k", "n", F.col("p")), cdf=stats.binomial_cdf("k", "n", F.col("p")), two=stats.binomial_two_sided("k", "n", F.col("p")))
    for r in got:
        sf, cdf = comb_sf(r.k, r.n, r.p), comb_cdf(r.k, r.n, r.p)
        assert r.sf == pytest.approx(sf, rel=1e-9, abs=1e-14) and r.cdf == pytest.approx(cdf, rel=1e-9, abs=1e-14)
        assert r.two == pytest.approx(min(1, 2 * min(sf, cdf)), rel=1e-9, abs=1e-14)
    assert comb_sf(7, 10, 0.5) == 176 / 1024


def test_binomial_of_many_trials(spark):
    """Far beyond what whole numbers in floats could hold: the normal tail is close by."""
    (r,) = column(spark, [(500_500_000, 1_000_000_000)], "k long, n long", p=stats.binomial_sf("k", "n"))
    z = (500_500_000 - 0.5 - 5e8) / math.sqrt(2.5e8)
    assert r.p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_trip_boundary(spark):
    got = {(r.e, r.n): r for r in column(spark, [(19, 30), (20, 30), (12, 19), (0, 0), (30, 30)], "e long, n long", **stats.trip("e", "n"))}
    assert not got[19, 30].tripped and got[20, 30].tripped and got[30, 30].tripped
    assert got[12, 19].inconclusive and got[12, 19].p_value == 1.0 and got[12, 19].rate == pytest.approx(12 / 19)
    assert got[0, 0].rate == 0.0 and got[0, 0].inconclusive


def test_clopper_pearson(spark):
    low, high = stats.clopper_pearson("k", "n")
    for r in column(spark, [(0, 0), (0, 10), (10, 10), (5, 10), (8, 30), (250, 299)], "k long, n long", low=low, high=high):
        if r.n == 0:
            assert (r.low, r.high) == (0, 1)
            continue
        assert r.low <= r.k / r.n <= r.high
        assert r.low == 0 if r.k == 0 else comb_sf(r.k, r.n, r.low) == pytest.approx(0.025, rel=1e-6)
        assert r.high == 1 if r.k == r.n else comb_cdf(r.k, r.n, r.high) == pytest.approx(0.025, rel=1e-6)


def test_fisher(spark):
    def exact(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        if 0 in (row, col, n - row, n - col):
            return 1.0
        f = lambda x: math.comb(row, x) * math.comb(n - row, col - x)
        return sum(f(x) for x in range(max(0, row + col - n), min(row, col) + 1) if f(x) <= f(a)) / math.comb(n, col)

    rng = random.Random(1)
    cases = [(30, 0, 15, 15), (15, 15, 15, 15), (2, 8, 8, 2), (0, 0, 5, 5), (0, 5, 0, 5)] + [tuple(rng.randrange(40) for _ in range(4)) for _ in range(60)] + [(100, 100, 128, 72), (500, 300, 480, 320)]
    for r in column(spark, cases, "a long, b long, c long, d long", p=stats.fisher_exact("a", "b", "c", "d")):
        assert r.p == pytest.approx(exact(r.a, r.b, r.c, r.d), rel=1e-8)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=2, max_size=2))
def test_tails_add_up(spark, x):
    k, n = min(x), max(x)
    (r,) = column(spark, [(k, n)], "k long, n long", sf=stats.binomial_sf("k", "n"), below=stats.binomial_cdf(F.col("k") - 1, "n"))
    assert n == 0 or r.sf + r.below == pytest.approx(1, abs=1e-12)


VERDICTS = {
    "A": "A", "B": "B", " b": "INVALID", "Answer B is better because...": "B", "I choose A.": "A", "It's a tie.": "TIE", "": "INVALID", "   \n": "INVALID", "The answers are both fine": "INVALID",
    "answer a question": "A", "(A) but in the end answer B": "B", "neither A nor B": "TIE", "( B )": "B", "B.": "B", "Both equal": "TIE", "option b": "B", "A tie": "A", "a": "INVALID", "Plan AB": "INVALID",
    "choice\u2003a": "A", "\u00a0\x1fB\u3000": "B", "A\u2003then": "A", "ÄA": "INVALID", "Aé": "INVALID", "OPTION\x1cb": "B",
}


def test_shortened(spark):
    rng = random.Random(4)
    values = [0.0, 1.0, 0.5, 0.25, 1e-5, 9.99996e-5, 0.000123456, 0.049999, 123456.7, 9999.6, 1e-300, 1e100, 3.0e-12] + [rng.random() * 10 ** rng.randrange(-12, 7) for _ in range(200)]
    for r in column(spark, [(x,) for x in values], "x double", s=stats.shortened("x")):
        assert r.s == f"{r.x:.4g}"


def test_parse_verdict(spark):
    for r in column(spark, [*[(x,) for x in VERDICTS], (None,)], "raw string", v=parse_verdict("raw")):
        assert r.v == VERDICTS.get(r.raw, "INVALID"), r.raw


def test_small_functions(spark):
    rows = column(spark, [("A", True), ("B", True), ("TIE", True), ("INVALID", True), ("A", False)], "v string, s boolean", u=unswap("v", "s"))
    assert [r.u for r in rows] == ["B", "A", "TIE", "INVALID", "A"]
    rows = column(spark, [("self-preference-003",), ("x",), ("-1",), ("a-b",)], "i string", p=probe_of("i"))
    assert [r.p for r in rows] == ["self-preference", "x", "", "a"]


MUST_TRIP = {
    "verbosity": "always_long", "position": "always_first", "self_preference": "always_self", "sycophancy": "sycophantic", "format": "prefer_bullets", "authority": "prefer_authority",
    "bandwagon": "follow_bandwagon", "halo": "prefer_endorsed", "complexity": "prefer_jargon",
}


@pytest.fixture(scope="module")
def items(spark):
    return probes.generate_items(probes.bank_frame(spark), 60, seed=2).cache()


def test_trip_matrix(spark, items):
    assert probes.broken_guards(probes.bank_frame(spark)).isEmpty()
    judged = judges.judged(items).withColumn("verdict", parse_verdict("raw"))
    got = {(r.judge, r.probe): r for r in battery.probe_results(battery.probe_counts(judged)).collect()}
    for probe, judge in MUST_TRIP.items():
        assert got[judge, probe].tripped and got[judge, probe].rate == 1.0, (probe, judge)
    for probe in PROBES:
        if probe != "position":
            assert not got["neutral_alternating", probe].tripped, probe
    assert not any(got["always_first", p].tripped for p in PROBES if p != "position")
    grade = {r.judge: r for r in battery.grades(battery.probe_results(battery.probe_counts(judged))).collect()}
    assert grade["always_first"].grade == "NEEDS ATTENTION" and grade["always_first"].n_probes == 9


def test_hashed_judge_follows_no_side(spark):
    many = probes.generate_items(probes.bank_frame(spark), 4000, seed=1)
    counts = battery.probe_counts(judges.judged(many, ("neutral_hash",)).withColumn("verdict", F.col("raw")))
    assert all(abs(r.events / r.n_valid - 0.5) < 0.05 for r in counts.collect())


def test_items(spark, items):
    count = {(r.probe, r.bias_side): r.n for r in items.groupBy("probe", "bias_side").agg(F.count("*").alias("n")).collect()}
    for p in PROBES:
        assert count.get((p, None), 0) == (60 if p == "position" else 0)
        assert p == "position" or 15 <= count[p, "A"] <= 45
    entries = probes.bank_frame(spark, ("verbosity", "position"))
    mt = [r.bias_side for r in probes.generate_items(entries, 40, seed=3, policy="python").where("probe = 'verbosity'").orderBy("item_no").collect()]
    rng = random.Random(3)
    assert mt == [rng.choice("AB") for _ in range(40)]
    assert items.exceptAll(probes.generate_items(probes.bank_frame(spark).repartition(7), 60, seed=2)).isEmpty()
    user = items.withColumn("user", probes.prompt())
    back = user.withColumns({f"back_{k}": v for k, v in probes.answers(F.col("user")).items()})
    assert back.where("back_answer_a <> answer_a OR back_answer_b <> answer_b").isEmpty()
    assert user.where("context = '' AND user LIKE '%\n\nAnswer A:%'").isEmpty()
    with pytest.raises(ValueError):
        probes.generate_items(entries, 0)


def test_ties_and_invalid_verdicts(spark):
    rows = [("j", "ties", f"ties-{k}", "A", "TIE" if k % 2 else "A") for k in range(40)]
    rows += [("j", f"bad{n}", f"bad{n}-{k}", "A", "INVALID" if k < n else "A") for n in (7, 8) for k in range(30)]
    got = {r.probe: r for r in battery.probe_results(battery.probe_counts(spark.createDataFrame(rows, "judge string, probe string, item_id string, bias_side string, verdict string"))).collect()}
    assert (got["ties"].n_valid, got["ties"].events) == (40, 20) and not got["ties"].tripped
    assert got["bad7"].tripped and not got["bad7"].inconclusive
    assert not got["bad8"].tripped and got["bad8"].inconclusive and got["bad8"].p_value < 0.05


def labels_frame(spark, votes):
    return spark.createDataFrame([("p", f"p-{i}", who, label, c) for i, votes_ in enumerate(votes) for who, label, c in votes_], "probe string, item_id string, labeler_id string, label string, confidence int")


def test_adjudication(spark):
    votes = [
        [("a", "A", 1), ("b", "A", 1), ("c", "B", 3)], [("a", "A", 1), ("b", "B", 3)], [("a", "A", 2), ("b", "B", 2)], [("a", "A", 1), ("b", "B", 1), ("c", "TIE", 1)], [("a", "B", 2)],
    ]
    got = {r.item_id: r for r in adjudication.gold_labels(labels_frame(spark, votes)).collect()}
    assert [got[f"p-{i}"].gold for i in range(5)] == ["A", "B", "TIE", "TIE", "B"]
    assert [got[f"p-{i}"].tie_broken for i in range(5)] == [False, True, False, False, False]
    assert [got[f"p-{i}"].unresolved for i in range(5)] == [False, False, True, True, False]
    assert [round(got[f"p-{i}"].agreement, 3) for i in range(5)] == [0.667, 0.5, 0.0, 0.333, 1.0]
    three = labels_frame(spark, [[("a", "A", 2), ("b", "A", 2), ("c", "B", 2)], [("a", "B", 2), ("b", "B", 2), ("c", "B", 2)]])
    r = adjudication.fleiss_kappa(three).first()
    assert r.kappa == pytest.approx(0.25) and r.n_items == 2
    assert adjudication.fleiss_kappa(labels_frame(spark, [[("a", "A", 2)]])).first().kappa == 0.0
    assert {r.pair: r.n for r in adjudication.pairwise_cohen(three).collect()} == {"a|b": 2, "a|c": 2, "b|c": 2}
    screen = adjudication.position_screen(labels_frame(spark, [[("a", "A", 2), ("b", "AB"[k % 2], 2)] for k in range(8)])).collect()
    assert {r.labeler_id: r.flagged for r in screen} == {"a": True, "b": False}


def test_calibration(spark):
    pairs = [("A", "A")] * 40 + [("B", "B")] * 40 + [("TIE", "TIE")] * 10 + [("A", "INVALID")] * 5 + [("A", "TIE")] * 3
    lab = spark.createDataFrame([(f"p-{i}", h, "ann") for i, (h, _) in enumerate(pairs)] + [("p-999", "A", "ann")], "item_id string, label string, labeler_id string")
    ver = spark.createDataFrame([("judge", "p", f"p-{i}", v) for i, (_, v) in enumerate(pairs)], "judge string, probe string, item_id string, verdict string")
    r = calibration.calibrate(lab, ver, judge_id="judge").first()
    assert (r.n_labeled, r.n_scored, r.tp, r.fn, r.tn, r.fp) == (98, 93, 40, 3, 40, 0)
    assert r.tpr == pytest.approx(40 / 43) and r.tnr == 1.0 and r.tnr_high == 1.0
    u = calibration.unmatched(calibration.resolved(lab), ver).first()
    assert (u.n_labels, u.n_unmatched) == (99, 1)
    with pytest.raises(calibration.Refused):
        calibration.calibrate(lab, ver, judge_id="ANN")
    with pytest.raises(calibration.Refused):
        calibration.calibrate(lab.unionByName(lab.limit(1)), ver)
    with pytest.raises(calibration.Refused):
        calibration.calibrate(lab, ver, known=spark.createDataFrame([("q",)], "probe string"))
    single = calibration.metrics(calibration.confusion(spark.createDataFrame([("j", "p", "TIE", "TIE")] * 25, "judge string, probe string, label string, verdict string"))).first()
    assert (single.tpr, single.tpr_low, single.tpr_high, single.kappa) == (0.0, 0.0, 1.0, 1.0)


def test_holm_and_drift(spark):
    p = [0.001, 0.04, 0.03, 0.2, 0.5, 0.9, 0.8, 0.7, 0.6]
    got = drift.holm(spark.createDataFrame([(1, str(k), x) for k, x in enumerate(p)], "c int, probe string, fisher_p double"), ["c"]).where("holm_significant").collect()
    assert [r.probe for r in got] == ["0"]
    schema = "probe string, n_valid long, events long, tripped boolean, inconclusive boolean"
    a = spark.createDataFrame([("flip", 30, 19, False, False), ("shift", 200, 100, True, False), ("quiet", 30, 15, False, False), ("open", 10, 5, False, True), ("gone", 30, 15, False, False), ("near", 100, 50, False, False)], schema)
    b = spark.createDataFrame([("flip", 30, 20, True, False), ("shift", 200, 140, True, False), ("quiet", 30, 15, False, False), ("open", 30, 30, True, False), ("new", 30, 15, False, False), ("near", 100, 59, False, False)], schema)
    rows = drift.compare(a, b.withColumn("run", F.lit(7)), ["run"])
    got = {r.probe: r for r in rows.collect()}
    assert set(got) == {"flip", "shift", "quiet", "open", "gone", "near"}
    assert got["flip"].alert_reason == "trip_flip" and got["shift"].alert_reason == "rate_shift" and not got["quiet"].alert
    assert got["open"].status == "inconclusive-involved" and not got["open"].alert and got["gone"].status == "absent-in-b"
    assert got["near"].watch and got["near"].watch_reason == "near-bar shift"
    s = drift.summary(rows, ["run"]).first()
    assert (s.n_compared, s.n_alerts, s.alerting, s.n_trip_flips, s.watching) == (5, 2, "flip,shift", 1, "near")


def test_rescoring(spark, items):
    blind = rescoring.blinded(items, seed=5)
    assert sorted(r.rescore_id for r in blind.collect()) == [f"rescore-{k:04d}" for k in range(540)]
    first = items.select("probe", "item_id", F.lit("A").alias("verdict"))
    again = blind.select("probe", "item_id", "swapped", "rescore_id", F.when(F.col("swapped"), "B").otherwise("A").alias("verdict"))
    got = {r.probe: r for r in rescoring.self_consistency(again, first).collect()}
    assert got[None].consistency == 1.0 and got[None].n == 540 and len(got) == 10
    ids = blind.select("rescore_id")
    rescoring.refuse_gaps(ids, ids)
    for bad in (ids.where("rescore_id <> 'rescore-0003'"), ids.unionByName(ids.limit(1)), ids.unionByName(spark.createDataFrame([("x",)], "rescore_id string"))):
        with pytest.raises(calibration.Refused):
            rescoring.refuse_gaps(ids, bad)


def test_ledger(spark, tmp_path, items):
    results = battery.probe_results(battery.probe_counts(judges.judged(items, ("always_first",)).withColumn("verdict", parse_verdict("raw"))))
    book = Ledger(spark, str(tmp_path / "ledger"))
    for k in range(3):
        assert book.append(results, ts=f"2024-01-0{k + 1}", judge="j", protocol_sha256="x", seed=k, grade="PASS", label=None if k else "first") == k + 1
    assert book.verify() == [] and [r.id for r in book.snapshots(since="2024-01-02").collect()] == [2, 3]
    assert book.choose() == (1, 3)
    book.pin(2, ts="2024-01-04", reason="new model")
    book.pin(1, ts="2024-01-05", reason="back")
    book.pin(2, ts="2024-01-06", reason="again")
    assert book.baseline() == 2 and book.choose() == (2, 3) and book.choose(baseline=1, target=2) == (1, 2)
    with pytest.raises(KeyError):
        book.snapshot(9)
    changed = book.snapshots().withColumn("grade", F.when(F.col("id") == 2, "FAIL").otherwise(F.col("grade")))
    assert [r.id for r in verify_chain(changed).where("NOT ok").collect()] == [2]
    assert [r.id for r in verify_chain(book.snapshots().where("id <> 2")).where("NOT ok").collect()] == [3]
    doubled = F.transform("probes", lambda p: p.withField("p_value", F.lit(0.9)))
    assert [r.id for r in verify_chain(book.snapshots().withColumn("probes", F.when(F.col("id") == 3, doubled).otherwise(F.col("probes")))).where("NOT ok").collect()] == [3]
    old = book.snapshots().withColumn("format", F.lit(None).cast("int")).collect()  # a ledger from before all fields were covered
    one = spark.createDataFrame(old, book.snapshots().schema).withColumn("text", record())
    hashes, before = [], "GENESIS"
    for r in one.orderBy("id").collect():
        before = hashlib.sha256((before + r.text).encode()).hexdigest()
        hashes.append((r.id, before))
    one = one.drop("text", "chain_hash").join(spark.createDataFrame(hashes, "id long, chain_hash string"), "id")
    assert verify_chain(one).where("NOT ok").isEmpty() and "0.9" not in one.select(record()).first()[0]
    many = spark.range(0, 20_000, 3).select("id", F.col("id").cast("string").alias("t"), F.sha2(F.concat(F.when(F.col("id") == 0, "GENESIS").otherwise(F.lit("x")), F.col("id").cast("string")), 256).alias("chain_hash"))
    assert [r.id for r in verify_chain(many, F.col("t")).where("ok").collect()] == [0]
    rows, seeds = drift.compare_snapshots(book.snapshot(1), book.snapshot(2))
    assert seeds and rows.where("alert").isEmpty() and rows.count() == 9


def test_label_files(spark, tmp_path):
    good = {"item_id": "p-1", "label": "A", "labeler_id": "ann", "timestamp": "2024-05-01T10:00:00Z"}
    bad = [
        ("label", {"label": "C"}), ("timestamp", {"timestamp": "not-a-time"}), ("confidence", {"confidence": None}), ("confidence", {"confidence": True}), ("confidence", {"confidence": 1.0}), ("confidence", {"confidence": 4}),
        ("item_id", {"item_id": 3}), ("labeler_id", {"labeler_id": " "}), ("probe", {"probe": ""}),
    ]
    path = tmp_path / "labels.jsonl"
    path.write_text("\n".join([json.dumps(good), "", json.dumps(good | {"confidence": 3, "probe": "q"}), "{oops", *[json.dumps(good | x) for _, x in bad]]))
    got = {r.line_no: r for r in labels.checked_labels(labels.numbered_lines(spark, str(path))).collect()}
    assert got[1].error is None and got[1].confidence == 2 and got[3].confidence == 3 and got[3].error is None
    assert got[4].error == "record" and 2 not in got
    for k, (field, x) in enumerate(bad, 5):
        assert got[k].error == field, x
    size = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(size, "100")  # the file in blocks, whose ends fall inside lines
    lines = labels.numbered_lines(spark, str(path))
    assert spark.read.text(str(path)).select("_metadata.file_block_start").distinct().count() > 3
    want = [(k, x) for k, x in enumerate(path.read_text().split("\n"), 1) if x]
    assert sorted((r.line_no, r.value) for r in lines.collect()) == want
    spark.conf.unset(size)
    with pytest.raises(labels.BadRecord, match="line 4: record"):
        labels.read_labels(spark, str(path))
    path.write_text(json.dumps(good) + "\n")
    assert labels.read_labels(spark, [str(path), str(path)]).count() == 2


def test_reports_and_replay(spark, tmp_path, items):
    judged = judges.judged(items, ("always_first",)).withColumn("verdict", parse_verdict("raw"))
    results = battery.probe_results(battery.probe_counts(judged))
    path = tmp_path / "report.json"
    path.write_text(reports.reports(results, judged).first().report)
    assert json.loads(path.read_text())["grade"] == "NEEDS ATTENTION"
    back = labels.read_report(spark, str(path))
    assert back.count() == 540 and back.exceptAll(judged.select("judge", "probe", "item_id", "verdict")).isEmpty()
    assert "| position | 60 | 60 | 1.0000 |" in reports.markdown(results, "always_first")
    body = json.loads(path.read_text())
    assert body["tool"] and body["generated_at"] and {p["probe"]: p["expected_direction"] for p in body["probes"]}["halo"] == "endorsed" and not body["probes"][0]["two_sided"]
    given = judged.where("probe IN ('halo', 'format')").select("probe", "item_id", F.when(F.col("bias_side") == "A", "A").otherwise("B").alias("label"), F.lit("ann").alias("labeler_id"), F.lit(2).alias("confidence"))
    given = given.unionByName(given.limit(1).withColumn("item_id", F.lit("halo-999"))).cache()
    bundle = reports.calibrated(given, back, "always_first", "sha")
    assert (bundle["labeler_id"], bundle["n_labels"], bundle["n_unmatched"]) == ("ann", 121, 1) and set(bundle["per_probe"]) == {"halo", "format"}
    halo = bundle["per_probe"]["halo"]
    assert halo["tpr"] == 1.0 and halo["tnr"] == 0.0 and halo["tnr_ci"][0] == 0.0 and halo["n_labeled"] == 60
    assert json.loads(reports.with_calibration(path.read_text(), bundle))["calibration"] == json.loads(json.dumps(bundle))
    assert "## Calibration" in (shown := reports.markdown(results, "always_first", bundle)) and "| halo | 60 | 1.000" in shown
    two = given.unionByName(given.withColumns({"labeler_id": F.lit("bo"), "label": F.lit("A")}))
    several = reports.calibrated_by_several(two, back, "always_first")
    assert several["labeler_ids"] == ["ann", "bo"] and several["n_items"] == 120 and several["n_unmatched"] == 2 and set(several["inter_rater"]["pairwise"]) == {"ann|bo"}
    flags = [f["flagged"] for f in several["position_flags"]]
    assert flags == sorted(flags, reverse=True) and flags[0] and several["position_flags"][0]["labeler_id"] == "bo"
    (tmp_path / "v").write_text("{oops\n")
    (tmp_path / "b").write_text(json.dumps({"id": "0", "system": "s", "user": "u"}) + "\n")
    with pytest.raises(labels.BadRecord, match="line 1: not JSON"):
        labels.read_replay(spark, str(tmp_path / "b"), str(tmp_path / "v"))
    (tmp_path / "b").write_text("".join(json.dumps({"id": str(k), "system": "s", "user": f"u{k}"}) + "\n" for k in range(3)))
    (tmp_path / "v").write_text("".join(json.dumps({"id": str(k), "verdict": "A"}) + "\n" for k in range(3)))
    assert labels.read_replay(spark, str(tmp_path / "b"), str(tmp_path / "v")).count() == 3
    (tmp_path / "v").write_text(json.dumps({"id": "0", "verdict": "A"}) + "\n")
    with pytest.raises(labels.BadRecord, match="no verdict"):
        labels.read_replay(spark, str(tmp_path / "b"), str(tmp_path / "v"))


def test_protocols(spark, tmp_path):
    path = str(tmp_path / "p.json")
    body = protocols.freeze(path, probes={"x": "1.0.0", "y": "1.0.0"}, n=30, seed=1)
    assert protocols.load(path)["sha256"] == body["sha256"] == protocols.build({"y": "1.0.0", "x": "1.0.0"}, 30, 1)["sha256"]
    rows = [("x", "1.0.0", 30, 1, 0.05, 20), ("y", "1.0.0", 30, 1, 0.05, 20)]
    schema = "probe string, version string, n_items long, seed long, alpha double, min_n long"
    protocols.verify(body, spark.createDataFrame(rows, schema))
    for bad, field in (([rows[0]], "y.probe"), ([rows[0], (*rows[1][:2], 29, 2, 0.05, 20)], "y.n_items"), ([(*rows[0][:3], 2, 0.05, 20), rows[1]], "x.seed")):
        with pytest.raises(protocols.ProtocolMismatch) as e:
            protocols.verify(body, spark.createDataFrame(bad, schema))
        assert e.value.field == field
    changed = json.loads((tmp_path / "p.json").read_text()) | {"seed": 2}
    (tmp_path / "p.json").write_text(json.dumps(changed))
    with pytest.raises(protocols.ProtocolMismatch):
        protocols.load(path)
    assert protocols.identity("a", {"x": "1"}) != protocols.identity("b", {"x": "1"}) != protocols.identity("b", {"x": "2"})
    assert {r.name for r in protocols.manifest(spark, path).collect()} == {"p.json"}
    (tmp_path / "p.json").write_text(json.dumps({k: v for k, v in body.items() if k != "tie_rule"}))
    with pytest.raises(protocols.ProtocolMismatch, match="tie_rule"):
        protocols.load(path)
    first = {k: v for k, v in body.items() if k != "sha256"} | {"protocol_version": "protocol-v1", "created_at": "2026-01-01"}
    sha = hashlib.sha256(json.dumps(first, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    (tmp_path / "p.json").write_text(json.dumps(first | {"sha256": sha}))
    assert protocols.load(path)["seed"] == 1
    (tmp_path / "p.json").write_text(json.dumps(first | {"sha256": sha, "created_at": "2026-01-02"}))
    with pytest.raises(protocols.ProtocolMismatch, match="sha256"):
        protocols.load(path)
    (tmp_path / "l").write_text("{oops\n")
    with pytest.raises(BadRecord):
        protocols.verify(body, spark.createDataFrame(rows, schema), str(tmp_path / "l"))
    assert set(body) >= {"frozen_bars", "label_schema", "tie_rule", "metrics", "created_at"} and body["frozen_bars"]["x"] == {"alpha": 0.05, "min_n": 20}


def definition(**changes):
    bank = {"items": [{"question": f"q{k}?", "short": "Yes.", "long": "Yes, and at some length."} for k in range(4)]}
    return {
        "name": "verbosity", "version": "2.1.0", "description": "d", "n_items": 4, "min_n": 20, "alpha": 0.05, "expected_direction": "long", "event": "picked_longer", "two_sided": False, "bias_meta_key": "longer",
        "defaults": {}, "generation": {"procedure": "p", "banks": bank}, "scoring": {"rule": "r", "trip_condition": "t"}, "frozen_bar": {"alpha": 0.05, "min_n": 20},
    } | changes


def test_definitions(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(json.dumps(definition()))
    (tmp_path / "b.json").write_text(json.dumps(definition(name="position", event="picked_first", expected_direction="first", bias_meta_key=None, version="1.0.0")))
    (tmp_path / "notes.txt").write_text("x")
    found = banks.discover(str(tmp_path))
    assert list(found) == ["verbosity", "position"] and found["verbosity"]["version"] == "2.1.0" and banks.bars_of(found)["position"] == {"alpha": 0.05, "min_n": 20}
    entries = probes.bank_frame(spark, ("verbosity",), {"verbosity": banks.entries_of(found["verbosity"])})
    assert entries.count() == 4 and probes.broken_guards(entries).isEmpty()
    bad = {
        "version": "1.0", "n_items": 0, "min_n": True, "alpha": 1, "expected_direction": "up", "event": "x", "two_sided": "no", "bias_meta_key": "y", "defaults": [], "generation": {"procedure": " ", "banks": {"a": []}},
        "scoring": {"rule": "r"}, "frozen_bar": {"alpha": 0.1, "min_n": 20},
    }
    for field, value in bad.items():
        with pytest.raises(ValueError, match=field):
            banks.checked_definition(definition(**{field: value}))
    for field in banks.KEYS:
        with pytest.raises(ValueError, match=field):
            banks.checked_definition({k: v for k, v in definition().items() if k != field})
    (tmp_path / "c.yaml").write_text("a: [")
    with pytest.raises(ValueError, match="not YAML"):
        banks.load_definition(str(tmp_path / "c.yaml"))


def test_a_probe_from_a_file(spark, tmp_path, capsys):
    """A tenth probe, which no code knows: its items, checks, and a run by the command."""
    from tribunal.cli import main

    bank = [{"question": f"What is {n}?", "cheerful": f"Oh wonderful! It is the number {n}.", "sober": f"It is the number {n}, as is known.", "markers": ["wonderful"]} for n in range(25)]
    spec = {"biased": "cheerful", "neutral": "sober", "sides": "fixed", "context": "A reader smiled at Answer {side}, not at {other}.", "ratio": 0.3, "vocabulary": ["wonderful", "splendid"], "least": 1}
    own = definition(name="cheer", event="picked_cheerful", expected_direction="cheerful", bias_meta_key="cheerful_side", generation={"procedure": "alternate", "banks": {"main": bank}, "spec": spec})
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "cheer.yaml").write_text(json.dumps(own))
    found = banks.discover(str(tmp_path / "d"))
    specs = probes.specs_of(found)
    entries = probes.bank_frame(spark, ("cheer",), {"cheer": banks.entries_of(found["cheer"])})
    assert probes.broken_guards(entries, specs).isEmpty() and probes.unbalanced(entries, specs).isEmpty()
    made = probes.generate_items(entries, 30, seed=4, policy="python", specs=specs).orderBy("item_no").collect()
    rng = random.Random(4)
    assert [r.bias_side for r in made] == [rng.choice("AB") for _ in range(30)] and made[27].answer_a == bank[2]["cheerful"]
    assert all(r.context == f"A reader smiled at Answer {r.bias_side}, not at {'B' if r.bias_side == 'A' else 'A'}." for r in made)
    run = ["run", "--definitions", str(tmp_path / "d"), "--judge", "always_first", "--n", "30", "--out", str(tmp_path / "r.json")]
    assert main(run) in (0, 1) and [p["probe"] for p in json.loads((tmp_path / "r.json").read_text())["probes"]] == ["cheer"]
    with pytest.raises(SystemExit, match="unknown"):
        main([*run, "--probes", "halo"])
    for change, broken in (({"neutral": "a wonderful day, and one."}, "markers"), ({"markers": ["splendid"]}, "markers"), ({"markers": []}, "markers"), ({"markers": ["odd"], "biased": "An odd wonder of one."}, "markers"), ({"neutral": "x"}, "lengths"), ({"neutral": ""}, "empty")):
        one = {"question": "q", "biased": "Oh wonderful! It is 1.", "neutral": "It is known to be one.", "markers": ["wonderful"]} | change
        assert [r.broken for r in probes.broken_guards(probes.bank_frame(spark, ("cheer",), {"cheer": [one]}), specs).collect()] == [broken]
    for bad in ({"sides": "both"}, {"context": "{nobody}"}, {"colour": 1}):
        with pytest.raises(ValueError):
            probes.specs_of({"cheer": own | {"generation": own["generation"] | {"spec": spec | bad}}})
    with pytest.raises(ValueError, match="generation.spec"):
        probes.specs_of({"cheer": definition(name="cheer")})


def test_parallel_draws(spark, tmp_path):
    """The same numbers as Python's generator, wherever blocks begin."""
    from tribunal.functions.twister import choices, draws

    rng = random.Random(11)
    words = [rng.getrandbits(32) for _ in range(4000)]
    assert all(draws(11, s, 300).tolist() == words[s : s + 300] for s in (0, 1, 623, 624, 625, 3700))
    for m, n, block in ((2, 5000, 700), (3, 1000, 64), (1, 10, 8), (6, 1, 100)):
        rng = random.Random(5)
        want = [rng.choice(range(m)) for _ in range(n)]
        got = choices(spark, 5, m, n, block).repartition(3).orderBy("item_no").collect()
        assert [r.drawn for r in got] == want and [r.item_no for r in got] == list(range(n))
    rng = random.Random(2)
    for _ in range(3_000_000):
        rng.getrandbits(32)
    assert draws(2, 3_000_000, 5).tolist() == [rng.getrandbits(32) for _ in range(5)]
    spark.createDataFrame([(k, "x") for k in range(500)], "event_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    from tribunal.plans.queries import drawn_sides

    rng, want = random.Random(7), []
    want = [k for k in range(500) if rng.choice("AB") == "A"]
    assert [tuple(r) for r in drawn_sides(spark, str(tmp_path)).collect()] == [("x", 500, len(want), sum(want))]


def test_canonical_json(spark):
    """Equal to json.dumps, over doubles of all kinds and texts with everything that is escaped."""
    from tribunal.functions.canonical import canonical_json

    rng = random.Random(1)
    special = [0.0, -0.0, 1e16, 1e15, 123456789012345680.0, 1e-4, 1e-5, 5e-324, 2.2e-322, 1.7976931348623157e308, 2.0e-3, 9007199254740993.0, 1 / 3, math.inf, -math.inf, math.nan, 5.444517870735015e39, 8.108151998898195e18, 8.335101662826196e17]
    number = lambda: rng.choice([lambda: struct.unpack("<d", rng.randbytes(8))[0], rng.random, lambda: float(rng.randrange(-(10**18), 10**18)), lambda: rng.randrange(1000) / 1000, lambda: rng.choice(special), lambda: 2.0 ** rng.randrange(-1074, 1023), lambda: 10.0 ** rng.randrange(-30, 30)])()
    text = lambda: "".join(rng.choice('ab "\\\n\r\t\b\f\x00\x1f\x7f~é漢😀\u2028') for _ in range(rng.randrange(8)))
    some = lambda f: f() if rng.random() > 0.05 else None
    given = [(some(number), some(text), rng.choice([True, False, None]), some(lambda: rng.randrange(-(2**63), 2**63)), some(lambda: {text(): number() for _ in range(rng.randrange(3))}), some(lambda: [some(lambda: (text(), 1)) for _ in range(rng.randrange(3))])) for _ in range(3000)]
    df = spark.createDataFrame(given, "x double, `é` string, b boolean, n long, m map<string,double>, a array<struct<z: string, k: int>>")
    other = 0
    for r in df.withColumn("j", canonical_json(F.struct(*df.columns), df.schema)).collect():
        whole = r.asDict(True)
        j = whole.pop("j")
        want = json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        if j != want:  # the other decimal of this length that reads back, see json_number
            other += 1
            assert len(j) == len(want) and json.loads(j) == json.loads(want)
    assert other <= 1
    with pytest.raises(TypeError):
        canonical_json(F.col("x"), "date")


def test_timestamps(spark):
    """As datetime.fromisoformat, over mutated dates by month and week, times, fractions and offsets."""
    from datetime import datetime

    from tribunal.functions.timestamps import is_timestamp

    rng = random.Random(3)
    one = lambda *x: rng.choice(x)

    def time() -> str:
        h, m, s, c = one(0, 23, 24, rng.randrange(24)), one(0, 59, 60, rng.randrange(60)), one(0, 59, 60, rng.randrange(60)), one("", ":")
        return one(f"{h:02d}", f"{h:02d}{c}{m:02d}", f"{h:02d}{c}{m:02d}{c}{s:02d}", f"{h:02d}{c}{m:02d}{c}{s:02d}{one('.', ',')}{rng.randrange(10 ** rng.randrange(1, 9))}")

    def stamp() -> str:
        y, m, d, w, k = one(0, 1, 4, 100, 1900, 2000, 2020, 2024, 2026, 9999, rng.randrange(1, 9999)), rng.randrange(14), one(0, 1, 28, 29, 30, 31, 32), one(0, 1, 52, 53, 54), rng.randrange(9)
        t = one(f"{y:04d}-{m:02d}-{d:02d}", f"{y:04d}{m:02d}{d:02d}", f"{y:04d}-W{w:02d}", f"{y:04d}W{w:02d}", f"{y:04d}-W{w:02d}-{k}", f"{y:04d}W{w:02d}{k}")
        if rng.random() < 0.7:
            t += one(*"T -t0W:") + time() + one("", "", "Z", "+" + time(), "-" + time())
        at = rng.randrange(len(t) + 1)
        return one(t, t, t[:at] + t[at + 1 :], t[:at] + one(*"09-:T+.,WZ x") + t[at:])

    def valid(t) -> bool:
        try:
            datetime.fromisoformat(t.replace("Z", "+00:00"))
        except ValueError:
            return False
        return True

    texts = sorted({stamp() for _ in range(8000)} | {"", "2024", "2026-W39-6", "2024-01-01T", "never"})
    got = {r.t: r.ok for r in spark.createDataFrame([(t,) for t in texts], "t string").withColumn("ok", is_timestamp(F.col("t"))).collect()}
    assert [t for t in texts if got[t] != valid(t)] == [] and 500 < sum(got.values())
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(is_timestamp(F.col("t"))).first()[0] is False


def test_power(spark):
    """The published power of a battery, and false alarms against every outcome of three probes."""
    from itertools import product

    from tribunal.operators import power

    table = power.power(spark.createDataFrame([(30,)], "n_valid long"), [0.6, 0.65, 0.7, 0.8]).orderBy("true_rate").collect()
    assert [round(r.power, 2) for r in table] == [0.29, 0.51, 0.73, 0.97] and {r.critical for r in table} == {20}
    assert round(1 - (1 - 0.05) ** 9, 2) == 0.37
    family, n = {"a": 14, "b": 15, "c": 22}, 22
    counts = spark.createDataFrame([("x", p, n, k) for p, k in family.items()] + [("y", "a", n, 11)], "c string, probe string, n_valid long, events long")

    def sticky_of(k, q):
        out = {}
        for lost, won in product(range(k + 1), range(n - k + 1)):
            out[k - lost + won] = out.get(k - lost + won, 0) + math.comb(k, lost) * q**lost * (1 - q) ** (k - lost) * math.comb(n - k, won) * q**won * (1 - q) ** (n - k - won)
        return out

    def fisher(a, b):
        w = lambda x: math.comb(n, x) * math.comb(n, a + b - x)
        return sum(w(x) for x in range(max(0, a + b - n), min(n, a + b) + 1) if w(x) <= w(a)) / math.comb(2 * n, a + b)

    bar = min(k for k in range(n + 2) if comb_sf(k, n, 0.5) < 0.05)
    for outcomes, of in ((power.resampled(counts, ["c"]), lambda k: {j: math.comb(n, j) * (k / n) ** j * (1 - k / n) ** (n - j) for j in range(n + 1)}), (power.sticky(counts, ["c"], 0.1), lambda k: sticky_of(k, 0.1))):
        flip = alert = 0.0
        for some in product(*[of(k).items() for k in family.values()]):
            w = math.prod(p for _, p in some)
            flips = [(j >= bar) != (k >= bar) for (j, _), k in zip(some, family.values(), strict=True)]
            tests, hit = sorted((fisher(k, j), abs(j - k) >= 0.15 * n) for (j, _), k in zip(some, family.values(), strict=True)), False
            for i, (p, large) in enumerate(tests):
                if p > 0.05 / (3 - i):
                    break
                hit |= large
            flip += w * any(flips)
            alert += w * (any(flips) or hit)
        got = {r.c: r for r in power.family_alarms(outcomes, ["c"], ["a", "b", "c"]).collect()}
        assert abs(got["x"].p_flip - flip) < 1e-9 and abs(got["x"].p_alert - alert) < 1e-9 and alert > flip > 0
        one = {(r.c, r.probe): r.p_flip for r in power.flips(outcomes, ["c"]).collect()}
        assert abs(got["y"].p_flip - one["y", "a"]) < 1e-12


def test_certain_events(spark):
    """Probabilities of 0 and 1 have answers, too."""
    for k, n in ((0, 10), (3, 10), (10, 10), (11, 10), (0, 0)):
        for p in (0.0, 1.0):
            r = spark.range(1).select(stats.binomial_sf(F.lit(k), F.lit(n), p).alias("sf"), stats.binomial_cdf(F.lit(k), F.lit(n), p).alias("cdf"), stats.binomial_two_sided(F.lit(k), F.lit(n), p).alias("two")).first()
            assert (r.sf, r.cdf) == (comb_sf(k, n, p), 1.0 if n <= 0 or k >= n else comb_cdf(k, n, p)) and 0 <= r.two <= 1


def test_several_judges(spark):
    """Each judge by itself: labels without a verdict, items with one, and second verdicts."""
    labels = spark.createDataFrame([("p", f"p-{k}", f"r{r}", "A" if k % 3 else "B", 2) for k in range(10) for r in range(2)] + [("q", "q-0", "r0", "A", 2)], "probe string, item_id string, labeler_id string, label string, confidence int")
    verdicts = spark.createDataFrame([("j1", "p", f"p-{k}", "A") for k in range(10)] + [("j2", "p", f"p-{k}", "B") for k in range(5)] + [("j3", "z", "z-1", "A")], "judge string, probe string, item_id string, verdict string")
    got = {(r.judge, r.probe): (r.n_labels, r.n_unmatched) for r in calibration.unmatched(labels, verdicts).collect()}
    assert got == {("j1", None): (21, 1), ("j1", "p"): (20, 0), ("j1", "q"): (1, 1), ("j2", None): (21, 11), ("j2", "p"): (20, 10), ("j2", "q"): (1, 1), ("j3", None): (21, 21), ("j3", "p"): (20, 20), ("j3", "q"): (1, 1)}
    covered = {(r.judge, r.probe): (r.n_items, r.n_unmatched) for r in adjudication.coverage(labels, verdicts).collect()}
    assert covered["j1", None] == (10, 1) and covered["j2", None] == (5, 11) and covered["j2", "p"] == (5, 10) and covered["j3", None] == (0, 21)
    assert [tuple(r) for r in calibration.unmatched(labels.limit(0), verdicts.where("judge = 'j1'")).collect()] == [("j1", None, 0, 0)]
    again = verdicts.where("probe = 'p' AND item_id < 'p-5'").withColumn("swapped", F.lit(False))
    same = {(r.judge, r.probe): (r.n, r.n_same) for r in rescoring.self_consistency(again, verdicts).collect()}
    assert same == {("j1", None): (5, 5), ("j1", "p"): (5, 5), ("j2", None): (5, 5), ("j2", "p"): (5, 5)}
    with pytest.raises(calibration.Refused):
        rescoring.self_consistency(again.drop("judge"), verdicts)
    with pytest.raises(calibration.Refused, match="j9/p/p-0"):
        rescoring.refuse_unscored(again.withColumn("judge", F.lit("j9")), verdicts)


def test_ledgers_of_the_common_form(spark, tmp_path):
    """A SQLite ledger, whose chain is over json.dumps, is verified; a changed row is found."""
    import sqlite3

    from tribunal.sources.ledger import FIELDS, from_sqlite

    db, last = sqlite3.connect(tmp_path / "l.db"), "GENESIS"
    db.execute("CREATE TABLE snapshots (id INTEGER PRIMARY KEY, ts, adapter_name, protocol_sha256, seed, n, grade, label, probes_json, chain_hash)")
    for k in range(6):
        names = ["probe_name", *FIELDS[1:]]
        probes_ = [dict(zip(names, (p, "1.0.0", "long", 30, 30 - k, k, 10 + k, (10 + k) / (30 - k), 1e-5 * (k + 1), 0.05, False, k > 3, False, k / 30, k, 20, 'é "quoted"'), strict=True)) for p in ("halo", "verbosity")]
        core = {"ts": f"2024-01-0{k + 1}T00:00:00+00:00", "adapter_name": "ä", "protocol_sha256": "x", "seed": k, "n": 30, "grade": "PASS", "label": "" if k % 2 else "week", "probes": probes_}
        last = hashlib.sha256((last + json.dumps(core, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()
        db.execute("INSERT INTO snapshots VALUES (?,?,?,?,?,?,?,?,?,?)", (k + 1, core["ts"], "ä", "x", k, 30, "PASS", core["label"], json.dumps(probes_), last))
    db.commit()
    assert verify_chain(from_sqlite(spark, str(tmp_path / "l.db"))).where("NOT ok").isEmpty()
    db.execute("UPDATE snapshots SET probes_json = replace(probes_json, '\"events\": 12', '\"events\": 13') WHERE id = 3")
    db.commit()
    assert [r.id for r in verify_chain(from_sqlite(spark, str(tmp_path / "l.db"))).where("NOT ok").collect()] == [3]
    db.close()


def test_judges_are_asked_once(spark, tmp_path):
    """Equal prompts, computed again, in another run, after a failure, and by a second attempt of a lost task."""
    import pandas as pd

    seen, broken = [], {"bad"}

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            user = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["user"]
            seen.append(user)
            body = json.dumps({"out": f"A {user}"}).encode()
            self.send_response(500 if user in broken else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        judge = http.custom(f"http://127.0.0.1:{server.server_port}/", '{"user": "{{user}}"}', "out")
        log, fast = f"file://{tmp_path}/log", {"retries": 1, "wait": 0.0, "parallel": 3}
        prompts = spark.createDataFrame([(f"i{k}", "s", f"q{k % 20}") for k in range(50)], "item_id string, system string, user string")
        got = http.asked_once(prompts, judge, log, **fast)
        assert got.count() == 50 and sorted(seen) == sorted(f"q{k}" for k in range(20))
        assert {(r.item_id, r.raw) for r in got.collect()} == {(f"i{k}", f"A q{k % 20}") for k in range(50)} and len(seen) == 20  # computed again
        more = spark.createDataFrame([("x", "s", u) for u in ("q1", "new", "other")] + [("y", "another system", "q1")], prompts.schema)
        assert http.asked_once(more, judge, log, **fast).count() == 4 and sorted(seen[20:]) == ["new", "other", "q1"]
        del seen[:]
        failing = spark.createDataFrame([("z", "s", u) for u in ("n1", "n2", "n3", "n4", "bad")], prompts.schema)
        with pytest.raises(Exception, match="status 500"):
            http.asked_once(failing, judge, log, retries=1, wait=0.0, parallel=1)
        assert seen.count("bad") == 2
        broken.clear()
        assert http.asked_once(failing, judge, log, **fast).count() == 5
        assert all(seen.count(u) == 1 for u in ("n1", "n2", "n3", "n4")) and seen.count("bad") == 3
        # an attempt that is lost after its third row, and the one after it
        rows = pd.DataFrame({"key": [f"k{k}" for k in range(6)], "system": "s", "user": [f"u{k}" for k in range(6)]})

        def lost():
            yield rows[:3]
            raise RuntimeError("lost")

        with pytest.raises(RuntimeError):
            list(http.logging_task(judge, log, "round", 0, 2, 0, 0.0)(lost()))
        list(http.logging_task(judge, log, "round", 0, 2, 0, 0.0)(iter([rows])))
        assert all(seen.count(f"u{k}") == 1 for k in range(6))
        before = {tuple(r) for r in http.replies(spark, log).collect()}
        http.compact(spark, log)
        assert {tuple(r) for r in http.replies(spark, log).collect()} == before and len(before) == 34
    finally:
        server.shutdown()


def test_judges_over_http(spark):
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), self.headers.get("x-api-key"), self.headers.get("X-Extra"), body))
            user = body.get("q") or body["messages"][-1]["content"]
            if "boom" in user:
                self.send_response(503)
                self.end_headers()
                self.wfile.write(b"busy")
                return
            replies = {"/v1/messages": {"content": [{"text": "A"}]}, "/judge": {"out": ["B"]}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(replies.get(self.path.split("?")[0], {"choices": [{"message": {"content": f"(A) {user}"}}]})).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        for url, path in ((base, "/v1/chat/completions"), (f"{base}/v1", "/v1/chat/completions"), (f"{base}/v1/?behavior=x", "/v1/chat/completions?behavior=x")):
            assert http.chat_completions(url, "m", "k").ask("s", "u") == "(A) u" and seen[-1][:2] == (path, "Bearer k")
        assert http.messages(base, "m", "k").ask("s", "u") == "A" and seen[-1][0] == "/v1/messages" and seen[-1][2] == "k"
        assert http.custom(f"{base}/judge", '{"q": "{{user}}"}', "out.0", ["X-Extra: 1:2"]).ask("s", "u") == "B" and seen[-1][3] == "1:2"
        with pytest.raises(http.JudgeError, match="503"):
            http.chat_completions(base, "m").ask("s", "boom")
        prompts = spark.createDataFrame([(f"i{k}", "s", f"u{k}") for k in range(20)], "item_id string, system string, user string")
        got = {r.item_id: r.raw for r in http.asked(prompts, http.chat_completions(base, "m"), 3).collect()}
        assert got == {f"i{k}": f"(A) u{k}" for k in range(20)}
    finally:
        server.shutdown()
    assert http.chat_completions().url == "http://localhost:11434/v1/chat/completions"
    with pytest.raises(ValueError):
        http.custom(base, "{}", "a", ["no colon"])


def test_http_judge():
    j = http.custom("http://localhost:1", '{"q": "{{user}}", "s": "{{system}}"}', "a.0.b", ["X-Key: a:b"])
    assert json.loads(j.body('s"{{user}}', "line\n\"é\"")) == {"q": "line\n\"é\"", "s": 's"{{user}}'} and j.headers == {"X-Key": "a:b"}
    assert http.extract({"a": [{"b": "A"}]}, "a.0.b") == "A"
    for body in ({"a": []}, {"a": [{"b": 3}]}, {}):
        with pytest.raises(http.JudgeError):
            http.extract(body, "a.0.b")
    assert json.loads(http.chat_completions("http://x/", "m").body("s", "u"))["temperature"] == 0
    assert "temperature" not in json.loads(http.messages("http://x", "m").body("s", "u"))
    with pytest.raises(http.JudgeError):
        j.ask("s", "u")


def test_stream(spark, tmp_path):
    """Weeks of runs over the same item ids, rows delivered twice or a day late, and a query that is stopped and started again: stream, batch and DuckDB agree."""
    schema = "ts string, judge string, run string, probe string, item_id string, bias_side string, raw string"
    rows = []
    for day in range(26):  # from a Thursday on, as windows are
        for judge in ("j", "k"):
            for probe in ("p", "q"):
                for k in range(24):
                    hit = (k % 2 == 0 or day >= 14) if (judge, probe) == ("j", "p") else k % 2 == 0
                    if k % 7 == day % 7:  # each item once a week
                        rows.append((f"2024-01-{4 + day:02d} 1{k % 10}:00:00", judge, f"week-{day // 7}", probe, f"{probe}-{k:03d}", "A", "A" if hit else "B" if k % 5 else "unclear"))
    files = [[r for r in rows if int(r[0][8:10]) in days] for days in (range(4, 13), range(13, 20), range(20, 30))]
    files[1] += files[0][-5:] + [r for r in files[1][:40]]  # twice, in the same file and in a later one
    late = [r for r in files[1] if r[0][8:10] == "19"][:3]
    files[1] = [r for r in files[1] if r not in late]
    files[2] = late + files[2]
    too_late = ("2024-01-02 10:00:00", "j", "week-0", "p", "p-900", "A", "A")
    make = lambda some: spark.createDataFrame(some, schema).withColumn("ts", F.to_timestamp("ts"))
    folder, check, seen = tmp_path / "in", str(tmp_path / "check"), []
    book = Ledger(spark, str(tmp_path / "ledger"))
    sink = lambda results, drift, number: seen.append((number, results.collect(), drift.collect()))
    for k, some in enumerate(files):
        make(some + [too_late] * (k == 2)).coalesce(1).write.parquet(str(folder / str(k)))
        stream = spark.readStream.schema(make(rows[:1]).schema).option("recursiveFileLookup", True).parquet(str(folder))
        watch(windowed_counts(stream), sink, check, book, source="weekly").awaitTermination(180)
        if k == 0:
            assert book.baseline() is None
    got = sorted(tuple(r[c] for c in ("start", "judge", "run", "probe", "n_items", "n_valid", "events")) for _, results, _ in seen for r in results)
    batch = windowed_counts(make([r for f in files for r in f])).where("start < timestamp'2024-01-25'")
    want = sorted(tuple(r[c] for c in ("start", "judge", "run", "probe", "n_items", "n_valid", "events")) for r in batch.collect())
    assert got == want and len(want) == 12
    import duckdb
    import pandas as pd

    table = pd.DataFrame([r for f in files for r in f], columns=schema.replace(" string", "").split(", "))  # noqa: F841
    sql = duckdb.sql("""SELECT start, judge, run, probe, count(*), count(*) FILTER (raw <> 'unclear'), count(*) FILTER (raw = 'A') FROM (SELECT time_bucket(INTERVAL 7 DAY, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01') AS start,
        judge, run, probe, item_id, arg_min(raw, ts) AS raw FROM "table" GROUP BY ALL) WHERE start < TIMESTAMP '2024-01-25' GROUP BY ALL ORDER BY ALL""").fetchall()
    assert sql == want
    alerts = {(d.start, d.judge, d.probe) for _, _, drift in seen for d in drift if d.alert}
    assert alerts and all(a[1:] == ("j", "p") for a in alerts)
    # each run of a window is a snapshot, once, in a whole chain
    shots = book.snapshots().collect()
    assert len(shots) == len({(r[0], r[1], r[2]) for r in want}) and book.verify() == [] and [r.id for r in shots] == list(range(1, len(shots) + 1))
    number, results, _ = seen[-1]
    again = spark.createDataFrame(results)
    assert book.append_runs(again, "weekly", number) is False and book.snapshots().count() == len(shots)
    # a batch that broke off before it was done is written anew
    folder_of = next(p for p in (tmp_path / "ledger" / "snapshots").iterdir() if p.name.endswith(f"-{number:012d}"))
    (folder_of / "_SUCCESS").unlink()
    assert book.append_runs(again, "weekly", number) is True and book.snapshots().count() == len(shots) and book.verify() == []


def test_batches_of_one_week(spark):
    """The same items in three weeks count in each of them."""
    rows = [(f"2024-01-{1 + 7 * w + 3:02d} 10:00:00", "j", f"r{w}", "verbosity", f"verbosity-{k:03d}", "A", "A") for w in range(3) for k in range(30)]
    df = spark.createDataFrame(rows, "ts string, judge string, run string, probe string, item_id string, bias_side string, raw string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.n_items for r in windowed_counts(df).collect()] == [30, 30, 30]


def test_as_of(spark):
    rng = random.Random(40)
    log = [(rng.choice("abc"), rng.randrange(200), rng.choice([None, rng.randrange(50)]), k) for k in range(300)]
    rows = [(rng.choice("abcd"), rng.randrange(-5, 210), k) for k in range(400)] + [(None, 5, 900), ("a", None, 901)]
    got = as_of(spark.createDataFrame(rows, "key string, at long, id long"), spark.createDataFrame([(*x, k) for x, k in zip([r[:3] for r in log], [r[3] for r in log], strict=True)] + [(None, 4, 7, 999)], "key string, at long, v long, nth long"), ["key"], "at", "v", lambda t: F.floor(t / 10), "nth")
    assert got.columns == ["key", "at", "id", "v"]

    def brute(key, at):
        found = [(a, n, v) for k, a, v, n in [*log, (None, 4, 7, 999)] if k == key and v is not None and at is not None and a <= at]
        return max(found)[2] if found else None

    assert {r.id: r.v for r in got.collect()} == {i: brute(k, a) for k, a, i in rows}


def test_baselines_as_of(spark, tmp_path):
    """Each snapshot against what was pinned for its judge by then; without a pin, against the judge's first."""
    book = Ledger(spark, str(tmp_path))
    results = lambda events: spark.createDataFrame([("halo", 30, 30, 0, events, events / 30, 0.5, events >= 20, False, 0.0)], "probe string, n_items long, n_valid long, n_invalid long, events long, rate double, p_value double, tripped boolean, inconclusive boolean, invalid_rate double")
    add = lambda ts, judge, events, sha="x": book.append(results(events), ts=ts, judge=judge, protocol_sha256=sha, seed=0, grade="PASS", n=30)
    for ts, judge, events in (("2024-01-01", "j", 15), ("2024-01-02", "k", 29), ("2024-01-08", "j", 29), ("2024-01-09", "k", 29)):
        add(ts, judge, events)
    book.pin(3, ts="2024-01-10", reason="after the release")
    add("2024-01-15", "j", 29)
    add("2024-01-16", "k", 5)
    add("2024-01-17", "j", 29, "y")
    got = {r.id: r.baseline_id for r in book.baselines_of().collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3, 6: 2, 7: 3}
    drift_of = {r.id: (r.baseline_id, r.alert) for r in book.history().collect()}
    assert drift_of == {3: (1, True), 4: (2, False), 5: (3, False), 6: (2, True)}  # 7 has another protocol
    with pytest.raises(Taken):
        stale = Ledger(spark, str(tmp_path))
        stale._read = lambda name, schema: book._read(name, schema).where("id < 7")  # a writer that read before the last append
        stale.append(results(3), ts="2024-01-18", judge="j", protocol_sha256="x", seed=0, grade="PASS")
    assert book.verify() == []


def test_commands(spark, tmp_path, capsys):
    from tribunal.cli import main

    p = str(tmp_path)
    assert main(["list-probes"]) == 0 and "halo" in capsys.readouterr().out
    judge = ["--judge", "always_first", "--probes", "position,halo", "--n", "30", "--seed", "1"]
    assert main(["run", *judge, "--out", f"{p}/r.json"]) == 1
    main(["protocol-freeze", "--probes", "position,halo", "--n", "30", "--seed", "1", "--out", f"{p}/p.json"])
    assert main(["protocol-verify", "--protocol", f"{p}/p.json", "--report", f"{p}/r.json"]) == 0
    main(["export-labeling-set", "--probes", "halo", "--n", "10", "--out", f"{p}/set"])
    spark.read.json(f"{p}/set/blinded").select("labeling_id", F.lit("A").alias("label"), F.lit(3).alias("confidence")).write.json(f"{p}/replies")
    main(["import-labels", "--sealed", f"{p}/set/sealed", "--replies", f"{p}/replies", "--labeler", "ann", "--ts", "2024-01-01", "--out", f"{p}/labels"])
    (tmp_path / "l.jsonl").write_text("".join(r.value + "\n" for r in spark.read.text(f"{p}/labels").collect()))
    for command in ("calibrate", "calibrate-multi"):
        main([command, "--labels", f"{p}/l.jsonl", "--report", f"{p}/r.json", "--judge", "always_first", "--protocol", f"{p}/p.json", "--copy", f"{p}/r2.json", "--out", f"{p}/c.json"])
        assert json.loads((tmp_path / "r2.json").read_text())["calibration"]["protocol_sha256"] == json.loads((tmp_path / "p.json").read_text())["sha256"]
        assert json.loads((tmp_path / "c.json").read_text())["per_probe"]["halo"]["tp"] == 10
    for k, name in enumerate(("always_first", "neutral_alternating"), 1):
        main(["drift-snapshot", "--judge", name, *judge[2:], "--ledger", f"{p}/ledger", "--ts", f"2024-01-0{k}"])
    main(["drift-baseline", "--ledger", f"{p}/ledger", "--id", "1", "--ts", "2024-01-03"])
    assert main(["drift-report", "--ledger", f"{p}/ledger"]) in (0, 1)
    main(["drift-snapshot", "--judge", "always_first", *judge[2:], "--ledger", f"{p}/ledger", "--ts", "2024-01-04"])
    capsys.readouterr()
    assert main(["drift-history", "--ledger", f"{p}/ledger"]) == 0 and capsys.readouterr().out == ""  # the same verdicts as the baseline's
