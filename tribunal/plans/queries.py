"""The registered queries of the measurement operators, and the same in DuckDB's SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.verdicts import is_event, parse_verdict, probe_of, unswap
from ..functions.canonical import canonical_json
from ..functions.timestamps import is_timestamp
from ..operators import adjudication, battery, calibration, drift, judges, power, probes, rescoring
from ..sources import labels as label_files
from ..sources import ledger
from ..sources.ledger import baselines_as_of as as_pinned
from ..streaming.verdicts import windowed_counts
from .derived import BANK, DAY_PROBES, DAYS, ITEMS, JUDGES, JUDGES_AGAIN, LABEL_LINES, LABELS, PINS, PROMPTS, RAW, REPLIES, RESCORES, SHOTS, STAMPS, STREAM, VERDICTS, VERDICTS_WITH_GAPS, WEEKS, bank_entries, derived, duckdb_sql


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- batteries

def _verdicts(spark, sf):
    return derived(spark, sf, RAW).withColumn("verdict", parse_verdict("raw"))


def _results(spark, sf):
    return battery.probe_results(battery.probe_counts(_verdicts(spark, sf)))


def battery_trip(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_results(spark, sf), "rate", "p_value", "invalid_rate")


def parse_verdict_mix(spark, sf):
    return _verdicts(spark, sf).groupBy("judge", "verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_event()).alias("events"))


def judge_grade(spark, sf):
    return battery.grades(_results(spark, sf))


def invalid_gate(spark, sf):
    out = _results(spark, sf).where(F.col("invalid_rate") > battery.INVALID_BAR).select("judge", "probe", "invalid_rate", "p_value", "tripped", "inconclusive")
    return rounded(out, "invalid_rate", "p_value")


def _pairs(spark, sf):
    return battery.probe_counts(_verdicts(spark, sf)).select("judge", "probe", "events", "n_valid")


def binomial_tails(spark, sf):
    out = _pairs(spark, sf).withColumns({"sf": stats.binomial_sf("events", "n_valid"), "cdf": stats.binomial_cdf("events", "n_valid"), "sf_third": stats.binomial_sf("events", "n_valid", 1 / 3)})
    return rounded(out, "sf", "cdf", "sf_third")


def two_sided_trip(spark, sf):
    out = battery.probe_results(battery.probe_counts(_verdicts(spark, sf)), two_sided=True).select("judge", "probe", "p_value", "tripped", "inconclusive")
    return rounded(out, "p_value")


#: True rates that a battery's power is asked for, and how often a judge flips a verdict when asked again.
TRUE_RATES, FLIPS = (0.6, 0.65, 0.7, 0.8), 4 / 270


def power_table(spark, sf):
    """How likely each judge's probe trips, with the valid verdicts it has, for four true rates."""
    return rounded(power.power(_pairs(spark, sf).drop("events"), TRUE_RATES), "power")


def flip_rates(spark, sf):
    """How likely each judge's probe changes sides: with other items at the same rate, and with the same items where few verdicts flip."""
    counts, by = _pairs(spark, sf), ["judge"]
    other = power.flips(power.resampled(counts, by), by).withColumnRenamed("p_flip", "p_other_items")
    return rounded(other.join(power.flips(power.sticky(counts, by, FLIPS), by).withColumnRenamed("p_flip", "p_same_items"), ["judge", "probe"]), "p_other_items", "p_same_items")


def mock_judges(spark, sf):
    names = ("always_long", "always_first", "always_self", "sycophantic", "prefer_bullets", "neutral_alternating", "prefer_authority", "follow_bandwagon", "prefer_endorsed", "prefer_jargon")
    items = derived(spark, sf, ITEMS).withColumns({
        "context": F.expr("CASE item_no % 6 WHEN 0 THEN 'Note: 87% of users preferred Answer B.' WHEN 2 THEN 'Editor''s pick: Answer B was highlighted.' WHEN 4 THEN 'Note: Answer B was written by JudgeModel. Answer A was written by RivalModel.' ELSE '' END"),
        "answer_a": F.expr("CASE WHEN item_no % 10 = 2 THEN concat(answer_a, ' MIT agree') ELSE answer_a END"),
        "answer_b": F.expr("CASE WHEN item_no % 10 = 4 THEN concat(answer_b, ' Absolutely; a stochastic paradigm (Vasquez)') ELSE answer_b END"),
    })
    return judges.judged(items, names).withColumn("verdict", parse_verdict("raw")).groupBy("judge", "probe", "verdict").agg(F.count(F.lit(1)).alias("n"))


# --- calibration

def _labels(spark, sf):
    return derived(spark, sf, LABELS)


def _calibrated(spark, sf):
    return calibration.calibrate(_labels(spark, sf), derived(spark, sf, VERDICTS), judge_id="steady")


def confusion_3x3(spark, sf):
    return calibration.confusion(calibration.matched(_labels(spark, sf), derived(spark, sf, VERDICTS)).where("verdict IS NOT NULL"))


def tpr_tnr(spark, sf):
    return rounded(_calibrated(spark, sf).select("judge", "probe", "tp", "fn", "tn", "fp", "tpr", "tnr"), "tpr", "tnr")


def cohen_kappa(spark, sf):
    return rounded(_calibrated(spark, sf).select("judge", "probe", "n_scored", "po", "pe", "kappa"), "po", "pe", "kappa")


def clopper_pearson(spark, sf):
    return rounded(_calibrated(spark, sf).select("probe", "tp", "fn", "tpr_low", "tpr_high", "tnr_low", "tnr_high"), "tpr_low", "tpr_high", "tnr_low", "tnr_high", digits=7)


def unmatched_labels(spark, sf):
    """Of the one judge there."""
    return calibration.unmatched(_labels(spark, sf), derived(spark, sf, VERDICTS_WITH_GAPS)).where("probe IS NULL").select("n_labels", "n_unmatched")


def probe_inference(spark, sf):
    """Probes from item ids alone, and the labels whose probe isn't among those of the documents."""
    rows = _labels(spark, sf).withColumn("inferred", probe_of("item_id"))
    return rows.groupBy("inferred").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("inferred") == F.col("probe")).alias("n_same"))


def label_validation(spark, sf):
    """Lines of a label file by the field that is wrong."""
    return label_files.checked_labels(derived(spark, sf, LABEL_LINES)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def generated_items(spark, sf):
    """As many items per language as there are documents, from banks of pairs: what doesn't hang on the drawn sides."""
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = probes.generate_items(bank_entries(spark, sf), n, seed=1)
    picked = F.when(F.col("bias_side") == "A", F.col("answer_a")).otherwise(F.col("answer_b"))
    return rows.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(probes.prompt())).alias("prompt_chars"), F.sum(F.length(picked)).alias("biased_chars"))


#: Probes that the library doesn't know, as data: each language is one.
OWN_SPECS = {s.name: s for s in (
    probes.Spec("en", sides="fixed", context="Reviewers chose Answer {side}, few chose {other}.", ratio=1.0), probes.Spec("de", context="{self} or {rival}?", biased_end=" (checked)", neutral_end=" (not checked)", longer=True),
    probes.Spec("fr", sides="orders", forbidden=("quality",)), probes.Spec("es", vocabulary=("data", "model"), balance=(0.5, 0.9)),
)}


def probe_specs(spark, sf):
    """Four probes defined as data, over banks of pairs of documents: as many items each as there are documents, what of them doesn't hang on the drawn sides, and the entries that break a rule."""
    n, entries = spark.read.parquet(f"{sf}/documents.parquet").count(), bank_entries(spark, sf).withColumn("markers", F.array().cast("array<string>"))
    rows = probes.generate_items(entries, n, seed=1, self_name="Own", other_name="Other", specs=OWN_SPECS)
    sided = F.count_if(F.col("bias_side").isNotNull())
    made = rows.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), sided.alias("n_sided"), F.sum(F.length(probes.prompt())).alias("prompt_chars"))
    unranked = derived(spark, sf, BANK).drop("bank_idx").withColumn("markers", F.array().cast("array<string>"))  # whose texts don't move for ranks
    broken = probes.broken_guards(unranked, OWN_SPECS).groupBy("probe").agg(*[F.count_if(F.col("broken") == x).alias(f"n_{x.split()[-1]}") for x in ("lengths", "not longer", "credential", "markers")])
    return made.join(broken, "probe", "left").na.fill(0)


def drawn_sides(spark, sf):
    """The sides of as many items as there are events, drawn as Python's generator does, in blocks that start anywhere in its sequence: how many A, and where the A stand."""
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    drawn = probes.sides(spark, n, 7)
    events = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") % n).alias("item_no"), "event_type")
    return events.join(drawn, "item_no").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "A").alias("n_a"), F.sum(F.when(F.col("side") == "A", F.col("item_no"))).alias("sum_a"))


def own_and_duplicate_labels(spark, sf):
    """What the refusals find: labels by the judge itself (rater2, in another case), and labels given twice (every fifth)."""
    rows = _labels(spark, sf)
    twice = calibration.duplicate_labels(rows.unionByName(rows.where("item_no % 5 = 0")))
    own = calibration.own_labels(rows, "RATER2").groupBy("probe").agg(F.count(F.lit(1)).alias("n_own"))
    return own.join(twice.groupBy("probe").agg(F.count(F.lit(1)).alias("n_twice"), F.sum("count").alias("n_labels")), "probe", "full").na.fill(0)


# --- several raters

def adjudicate_gold(spark, sf):
    return rounded(adjudication.gold_labels(_labels(spark, sf)), "agreement")


def fleiss_kappa(spark, sf):
    return rounded(adjudication.fleiss_kappa(_labels(spark, sf)), "kappa")


def pairwise_cohen(spark, sf):
    return rounded(adjudication.pairwise_cohen(_labels(spark, sf)), "po", "pe", "kappa")


def labeler_vs_gold(spark, sf):
    labels = _labels(spark, sf)
    return rounded(adjudication.labeler_vs_gold(labels, adjudication.gold_labels(labels)), "po", "pe", "kappa")


def position_screen(spark, sf):
    return rounded(adjudication.position_screen(_labels(spark, sf)), "a_rate", "p_value")


def calibrate_multi(spark, sf):
    out = adjudication.calibrate_gold(_labels(spark, sf), derived(spark, sf, VERDICTS), judge_id="steady")
    return rounded(out.select("judge", "probe", "n_labeled", "n_scored", "tp", "fn", "tn", "fp", "kappa"), "kappa")


def label_coverage(spark, sf):
    """Of the one judge there."""
    return adjudication.coverage(_labels(spark, sf), derived(spark, sf, VERDICTS_WITH_GAPS)).where("probe IS NULL").select("n_items", "n_unresolved", "n_unmatched")


def judge_coverage(spark, sf):
    """Three judges of different gaps: labels without a verdict, and items with one, for each judge by language and in all."""
    labels, verdicts = _labels(spark, sf), derived(spark, sf, JUDGES)
    left = calibration.unmatched(labels, verdicts)
    items = adjudication.coverage(labels, verdicts).withColumnRenamed("n_unmatched", "n_votes_unmatched")
    same = left.judge.eqNullSafe(items.judge) & left.probe.eqNullSafe(items.probe)
    return left.join(items, same).select(left.judge, left.probe, "n_labels", "n_unmatched", "n_items", "n_unresolved", "n_votes_unmatched")


def judge_consistency(spark, sf):
    """How often each of three judges agrees with itself."""
    first = derived(spark, sf, JUDGES)
    return rounded(rescoring.self_consistency(rescoring.refuse_unscored(derived(spark, sf, JUDGES_AGAIN), first), first), "consistency", "low", "high", digits=7)


def self_consistency(spark, sf):
    out = rescoring.self_consistency(derived(spark, sf, RESCORES), derived(spark, sf, VERDICTS).drop("judge"))
    return rounded(out, "consistency", "low", "high", digits=7)


def unswapped_verdicts(spark, sf):
    return derived(spark, sf, RESCORES).withColumn("verdict", unswap("verdict", "swapped")).groupBy("probe", "verdict").agg(F.count(F.lit(1)).alias("n"))


def replay_join(spark, sf):
    """A recorded session, whose prompts are matched to those asked now by a digest of their texts: the verdicts by probe."""
    recorded = label_files.replayed(derived(spark, sf, PROMPTS).select("id", "system", "user"), derived(spark, sf, REPLIES))
    asked = derived(spark, sf, PROMPTS).select("probe", F.sha2(F.concat_ws("\0", "system", "user"), 256).alias("prompt_key"))
    return asked.join(recorded.select("prompt_key", "verdict"), "prompt_key").groupBy("probe", parse_verdict("verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# --- drift

def _weeks(spark, sf):
    return battery.probe_results(derived(spark, sf, WEEKS).withColumn("invalid_rate", F.lit(0.0)))


def _compared(spark, sf):
    weeks = _weeks(spark, sf)
    return drift.compare(weeks.where("week = 0"), weeks.where("week > 0"), ["week"])


def weekly_snapshots(spark, sf):
    return rounded(_weeks(spark, sf).select("week", "probe", "n_valid", "events", "rate", "p_value", "tripped", "inconclusive"), "rate", "p_value")


def fisher_weeks(spark, sf):
    return rounded(_compared(spark, sf).select("week", "probe", "rate_a", "rate_b", "delta", "fisher_p"), "rate_a", "rate_b", "delta", "fisher_p")


def holm_reject(spark, sf):
    return _compared(spark, sf).select("week", "probe", "holm_significant")


def drift_alerts(spark, sf):
    return _compared(spark, sf).select("week", "probe", "status", "trip_flip", "alert", "alert_reason", "watch", "watch_reason")


def drift_summary(spark, sf):
    return drift.summary(_compared(spark, sf), ["week"])


# --- ledger

def chain_verify(spark, sf):
    """A chain over the days' records, with one record changed afterwards: the digest of each link, and whether it holds."""
    days = derived(spark, sf, DAYS).withColumn("id", F.col("id").cast("int"))
    chain = ledger.linked(days.withColumn("__text", F.col("record")), ledger.GENESIS)
    changed = chain.withColumn("record", F.when(F.col("id") == 11, F.concat("record", F.lit("!"))).otherwise(F.col("record")))
    return changed.select("id", "chain_hash").join(ledger.verify_chain(changed, F.col("record")), "id")


def canonical_chain(spark, sf):
    """The same over canonical JSON of nested records: what a snapshot of each day and type of event holds; the record of day 5 has another number afterwards."""
    days = derived(spark, sf, DAY_PROBES).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("probe", "events", "n_valid", "rate", "tripped"))).alias("probes"))
    text = lambda df: canonical_json(F.struct(F.col("id").alias("seed"), F.lit(None).cast("string").alias("label"), "probes"), df.select(F.struct(F.col("id").alias("seed"), F.lit(None).cast("string").alias("label"), "probes").alias("r")).schema["r"].dataType)
    chain = ledger.linked(days.withColumn("__text", text(days)), ledger.GENESIS)
    changed = chain.withColumn("probes", F.when(F.col("id") == 5, F.transform("probes", lambda p: p.withField("events", p["events"] + 1))).otherwise(F.col("probes")))
    return changed.select("id", "chain_hash").join(ledger.verify_chain(changed, text(changed)), "id")


def canonical_records(spark, sf):
    """The digest of each document's canonical JSON, its whole text among it."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.struct("text", "lang", F.struct("source", (F.col("n_chars") / F.lit(7.0)).alias("weeks"), (F.col("n_chars") % 2 == 0).alias("even")).alias("about"), F.array(F.lit(0.1), F.col("doc_id") * F.lit(1e14)).alias("numbers")).alias("r"))
    return rows.select("doc_id", F.sha2(canonical_json(F.col("r"), rows.schema["r"].dataType), 256).alias("sha256"))


def timestamp_forms(spark, sf):
    """Events' times written in a dozen forms, some of them wrong: how many of each form are timestamps."""
    return derived(spark, sf, STAMPS).groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_timestamp(F.col("stamp"))).alias("n_valid"))


def snapshots_since(spark, sf):
    """Daily snapshots from a time on, by the text of the time, with the baseline (the earliest) and target (the latest) of that range."""
    days = derived(spark, sf, DAYS).withColumn("ts", F.concat(F.lit("2024-01-"), F.lpad((F.col("id") + 1).cast("string"), 2, "0"))).where("ts >= '2024-01-15'")
    ends = days.agg(F.min("id").alias("baseline"), F.max("id").alias("target"))
    return days.select("id", "ts").withColumns({"is_baseline": F.col("id") == ends.select("baseline").scalar(), "is_target": F.col("id") == ends.select("target").scalar()})


def stream_weeks(spark, sf):
    """Events read as a stream of verdicts, counted by run, probe and week: the weeks that closed, a day after their end, with the test of each count."""
    events = f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(f"{events[:-1]}[t]")  # a pattern, since a stream takes no single file
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-')}/weeks-{uuid.uuid4().hex}"
    counts = windowed_counts(derived(spark, sf, STREAM, events=stream))
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/weeks/batch={number}")
    counts.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(counts.schema).parquet(f"{path}/weeks").drop("batch")
    return rounded(battery.probe_results(found.withColumn("start", F.date_format("start", "yyyy-MM-dd"))), "rate", "p_value", "invalid_rate")


def baselines_as_of(spark, sf):
    """Each snapshot of twenty judges with the baseline that was pinned for its judge by then, else the judge's first snapshot."""
    shots = derived(spark, sf, SHOTS)
    return as_pinned(shots, derived(spark, sf, PINS), shots)


def baseline_current(spark, sf):
    """A log in which every event of type click pins its user's hour; the last entry per user holds."""
    log = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'")
    return log.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("baseline"), F.count(F.lit(1)).alias("n_pins"))


def blinded_set(spark, sf):
    """What of a blinded set doesn't hang on the draw, by probe: each item once, with its two answers in either order; and numbers without gaps over all."""
    rows = rescoring.blinded(derived(spark, sf, ITEMS), seed=7)
    nth = F.split_part("rescore_id", F.lit("-"), F.lit(2)).cast("long")
    kept = F.when(F.col("swapped"), F.concat("answer_b", "answer_a")).otherwise(F.concat("answer_a", "answer_b"))
    over = rows.agg((F.count_distinct(nth) - (F.max(nth) - F.min(nth) + 1)).alias("gaps"))
    by = rows.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("n_items"), F.sum(F.length("answer_a") + F.length("answer_b")).alias("chars"), F.max(F.sha2(kept, 256)).alias("last_answers"))
    return by.withColumn("gaps", over.scalar())


QUERIES = {f.__name__: f for f in (
    battery_trip, parse_verdict_mix, judge_grade, invalid_gate, binomial_tails, two_sided_trip, mock_judges, confusion_3x3, tpr_tnr, cohen_kappa, clopper_pearson,
    unmatched_labels, probe_inference, label_validation, generated_items, own_and_duplicate_labels, adjudicate_gold, fleiss_kappa, pairwise_cohen, labeler_vs_gold, position_screen, calibrate_multi,
    label_coverage, self_consistency, unswapped_verdicts, replay_join, weekly_snapshots, fisher_weeks, holm_reject, drift_alerts, drift_summary, chain_verify,
    snapshots_since, baseline_current, blinded_set, judge_coverage, judge_consistency, stream_weeks, baselines_as_of, power_table, flip_rates,
    canonical_chain, canonical_records, timestamp_forms, probe_specs, drawn_sides,
)}

# --- the same for DuckDB

_PARSED = f"""raw AS ({RAW}), v AS (SELECT *, CASE
    WHEN regexp_matches(raw, '(?i)(answer|option|choice)\\s+[ab]\\b') THEN upper(regexp_extract(raw, '(?i)(answer|option|choice)\\s+([ab])\\b', 2))
    WHEN regexp_matches(raw, '\\(\\s*[AB]\\s*\\)') THEN regexp_extract(raw, '\\(\\s*([AB])\\s*\\)', 1)
    WHEN regexp_matches(raw, '^\\s*[AB]([\\s.,:;!]|$)') THEN regexp_extract(raw, '^\\s*([AB])([\\s.,:;!]|$)', 1)
    WHEN regexp_matches(raw, '(?i)\\b(tie|draw|equal|neither)\\b') THEN 'TIE'
    WHEN regexp_matches(raw, '\\b[AB]\\b') THEN regexp_extract(raw, '\\b([AB])\\b', 1) ELSE 'INVALID' END AS verdict FROM raw)"""


def _pmf(i: str, n: str, p: str) -> str:
    return f"exp(lgamma({n} + 1) - lgamma({i} + 1) - lgamma({n} - {i} + 1) + {i} * ln({p}) + ({n} - {i}) * ln(1 - {p}))"


def _sf(k: str, n: str, p: str = "0.5") -> str:
    return f"CASE WHEN {n} <= 0 OR {k} <= 0 THEN 1.0 WHEN {k} > {n} THEN 0.0 ELSE list_sum(list_transform(range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1), lambda i: {_pmf('i', n, p)})) END"


def _cdf(k: str, n: str, p: str = "0.5") -> str:
    return f"CASE WHEN {n} <= 0 OR {k} >= {n} THEN 1.0 WHEN {k} < 0 THEN 0.0 ELSE list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: {_pmf('i', n, p)})) END"


_COUNTS = f"""{_PARSED}, c AS (SELECT judge, probe, count(*) AS n_items, count(*) FILTER (verdict <> 'INVALID') AS n_valid, count(*) FILTER (verdict = 'INVALID') AS n_invalid,
    count(*) FILTER (verdict = bias_side) AS events FROM v GROUP BY ALL)"""
_RESULTS = f"""{_COUNTS}, t AS (SELECT *, n_invalid / n_items AS invalid_rate, CASE WHEN n_valid > 0 THEN events / n_valid ELSE 0.0 END AS rate,
    CASE WHEN n_valid < 20 THEN 1.0 ELSE {_sf('events', 'n_valid')} END AS p FROM c),
    r AS (SELECT *, n_valid >= 20 AND p < 0.05 AND invalid_rate <= 0.25 AS tripped, n_valid < 20 OR invalid_rate > 0.25 AS inconclusive FROM t)"""

_MATCHED = f"""l AS ({LABELS}), v AS ({VERDICTS}), m AS (SELECT l.*, v.judge, v.verdict FROM l LEFT JOIN v USING (probe, item_id))"""
_MISSING = f"""l AS ({LABELS}), v AS ({VERDICTS_WITH_GAPS}), m AS (SELECT l.*, v.verdict FROM l LEFT JOIN v USING (probe, item_id))"""


def _cells(x: str = "verdict", y: str = "label") -> str:
    return ", ".join(f"count(*) FILTER ({x} = '{j}' AND {y} = '{h}') AS {j.lower()}_{h.lower()}" for j in ("A", "B", "TIE") for h in ("A", "B", "TIE"))


_ONE = f"""{_MATCHED}, k AS (SELECT judge, probe, count(*) AS n_labeled, count(*) FILTER (verdict <> 'INVALID') AS n_scored, {_cells()}
    FROM m WHERE verdict IS NOT NULL GROUP BY ALL),
    q AS (SELECT *, a_a AS tp, b_a + tie_a AS fn, b_b AS tn, a_b + tie_b AS fp FROM k)"""


def _kappa(source: str, keep: str) -> str:
    r = {j: " + ".join(f"{j}_{h}" for h in ("a", "b", "tie")) for j in ("a", "b", "tie")}
    c = {h: " + ".join(f"{j}_{h}" for j in ("a", "b", "tie")) for h in ("a", "b", "tie")}
    return f"""SELECT {keep}, s, ch, nn, CASE WHEN nn > 0 THEN s / nn ELSE 0.0 END AS po, CASE WHEN nn > 0 THEN ch / (nn * nn) ELSE 0.0 END AS pe
        FROM (SELECT *, a_a + b_b + tie_tie AS s, {' + '.join(f'({r[x]}) * ({c[x]})' for x in ('a', 'b', 'tie'))} AS ch, {' + '.join(r.values())} AS nn FROM {source})"""


_K = "CASE WHEN nn = 0 THEN 0.0 WHEN ch = nn * nn THEN CASE WHEN s = nn THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END"

_GOLD = f"""g0 AS (SELECT probe, item_id, label, count(*) AS n, sum(confidence) AS conf FROM l GROUP BY ALL),
    g1 AS (SELECT *, max(n) OVER w AS top, sum(n) OVER w AS votes FROM g0 WINDOW w AS (PARTITION BY probe, item_id)),
    g2 AS (SELECT *, max(CASE WHEN n = top THEN conf END) OVER (PARTITION BY probe, item_id) AS best FROM g1),
    g3 AS (SELECT probe, item_id, max(votes) AS votes, count(*) FILTER (n = top) AS leaders, count(*) FILTER (n = top AND conf = best) AS heads,
        min(label) FILTER (n = top AND conf = best) AS head, max(top) AS top, coalesce(max(n) FILTER (label = 'TIE'), 0) AS ties FROM g2 GROUP BY ALL),
    gold AS (SELECT probe, item_id, CASE WHEN leaders > 1 AND heads > 1 THEN 'TIE' ELSE head END AS gold, CAST(votes AS BIGINT) AS n_labelers,
        (CASE WHEN leaders > 1 AND heads > 1 THEN ties ELSE top END) / votes AS agreement, leaders > 1 AND heads = 1 AS tie_broken, leaders > 1 AND heads > 1 AS unresolved FROM g3)"""


def _bisect(source: str, keys: str, k: str, n: str, upper: bool) -> str:
    """A recursive query (keys, p): 52 halvings of (0, 1)."""
    test = f"{_cdf('k', 'n', 'mid')} > 0.025" if upper else f"{_sf('k', 'n', 'mid')} < 0.025"
    return f"""(WITH RECURSIVE b AS (SELECT {keys}, CAST({k} AS DOUBLE) AS k, CAST({n} AS DOUBLE) AS n, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM {source}
        UNION ALL SELECT {keys}, k, n, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, step + 1
        FROM (SELECT *, {test} AS below FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE step < 52)))
        SELECT {keys}, CASE WHEN n <= 0 OR {'k >= n' if upper else 'k <= 0'} THEN {'1.0' if upper else '0.0'} ELSE (lo + hi) / 2 END AS p FROM b WHERE step = 52)"""


_WEEKS = f"""w AS ({WEEKS}), ws AS (SELECT *, CASE WHEN n_valid > 0 THEN events / n_valid ELSE 0.0 END AS rate, CASE WHEN n_valid < 20 THEN 1.0 ELSE {_sf('events', 'n_valid')} END AS p_value FROM w),
    s AS (SELECT *, n_valid >= 20 AND p_value < 0.05 AS tripped, n_valid < 20 AS inconclusive FROM ws)"""
_HYPER = "lgamma(r + 1) - lgamma({x} + 1) - lgamma(r - {x} + 1) + lgamma(t - r + 1) - lgamma(c - {x} + 1) - lgamma(t - r - c + {x} + 1) - lgamma(t + 1) + lgamma(c + 1) + lgamma(t - c + 1)"
_DRIFT = f"""{_WEEKS}, j AS (SELECT y.week, y.probe, x.rate AS rate_a, y.rate AS rate_b, y.rate - x.rate AS delta, x.tripped AS ta, y.tripped AS tb, x.inconclusive OR y.inconclusive AS io,
        x.events AS a, x.n_valid AS r, x.events + y.events AS c, x.n_valid + y.n_valid AS t FROM s x JOIN s y USING (probe) WHERE x.week = 0 AND y.week > 0),
    f AS (SELECT *, CASE WHEN c = 0 OR c = t THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(CAST(greatest(0, r + c - t) AS BIGINT), CAST(least(r, c) AS BIGINT) + 1),
        lambda x: CASE WHEN {_HYPER.format(x='x')} <= {_HYPER.format(x='a')} + 1e-7 THEN exp({_HYPER.format(x='x')}) ELSE 0.0 END))) END AS fisher_p FROM j),
    h AS (SELECT *, min(CASE WHEN fisher_p <= 0.05 / (m - k + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY week ORDER BY fisher_p, probe ROWS UNBOUNDED PRECEDING) = 1 AS holm_significant
        FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY fisher_p, probe) AS k, count(*) OVER (PARTITION BY week) AS m FROM f)),
    d AS (SELECT *, CASE WHEN io THEN 'inconclusive-involved' ELSE 'compared' END AS status, NOT io AND ta <> tb AS trip_flip, NOT io AND holm_significant AND abs(delta) >= 0.15 AS shift FROM h),
    z AS (SELECT *, trip_flip OR shift AS alert, NOT (trip_flip OR shift) AND NOT io AND abs(delta) >= 0.075 AS watch FROM d)"""

#: Word bounds with all non-ASCII characters as letters, as in the data.
_NAMED = "(?i)(^|[^0-9A-Za-z_\\x{80}-\\x{10FFFF}])(vasquez|mit)($|[^0-9A-Za-z_\\x{80}-\\x{10FFFF}])"
_WORDS = "(?i)(^|[^0-9A-Za-z_\\x{80}-\\x{10FFFF}])(data|model)($|[^0-9A-Za-z_\\x{80}-\\x{10FFFF}])"
_MOCK = f"""i AS (SELECT probe, item_no, item_no % 6 AS six, item_no % 10 AS ten, trim(answer_a, chr(10) || chr(9) || ' ') AS a, trim(answer_b, chr(10) || chr(9) || ' ') AS b FROM ({ITEMS})),
    x AS (SELECT probe, six, ten, CASE WHEN ten = 2 THEN a || ' MIT agree' ELSE a END AS a, CASE WHEN ten = 4 THEN b || ' Absolutely; a stochastic paradigm (Vasquez)' ELSE b END AS b,
        row_number() OVER (PARTITION BY probe ORDER BY item_no) AS rn FROM i),
    y AS (SELECT probe, unnest([{{'j': 'always_long', 'v': CASE WHEN length(a) >= length(b) THEN 'A' ELSE 'B' END}}, {{'j': 'always_first', 'v': 'A'}},
        {{'j': 'always_self', 'v': CASE WHEN six = 4 THEN 'B' ELSE 'A' END}}, {{'j': 'sycophantic', 'v': CASE WHEN ten = 4 THEN 'B' ELSE 'A' END}},
        {{'j': 'prefer_bullets', 'v': CASE WHEN contains(a, chr(10) || '- ') THEN 'A' WHEN contains(b, chr(10) || '- ') THEN 'B' ELSE 'A' END}},
        {{'j': 'neutral_alternating', 'v': CASE WHEN rn % 2 = 1 THEN 'A' ELSE 'B' END}}, {{'j': 'prefer_authority', 'v': CASE WHEN regexp_matches(b, '{_NAMED}') AND NOT regexp_matches(a, '{_NAMED}') THEN 'B' ELSE 'A' END}},
        {{'j': 'follow_bandwagon', 'v': CASE WHEN six = 0 THEN 'B' ELSE 'A' END}}, {{'j': 'prefer_endorsed', 'v': CASE WHEN six = 2 THEN 'B' ELSE 'A' END}},
        {{'j': 'prefer_jargon', 'v': CASE WHEN ten = 4 THEN 'B' ELSE 'A' END}}]) AS u FROM x)"""

_CHAIN = f"""WITH RECURSIVE days AS ({DAYS}), o AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM days),
    ch AS (SELECT id, k, sha256('GENESIS' || record) AS chain_hash FROM o WHERE k = 1 UNION ALL SELECT o.id, o.k, sha256(ch.chain_hash || o.record) FROM ch JOIN o ON o.k = ch.k + 1)
    SELECT CAST(id AS INT) AS id, chain_hash, id <> 11 AS ok FROM ch"""

_CRITICAL = f"list_filter(range(0, n_valid + 2), lambda k: {_sf('k', 'n_valid')} < 0.05)[1]"
_BARS = f"{_COUNTS}, b AS MATERIALIZED (SELECT n_valid, {_CRITICAL} AS critical FROM (SELECT DISTINCT n_valid FROM c))"


def _point(i: str, n: str, q: float) -> str:
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE {_pmf(i, n, str(q))} END"


def _json(x: str) -> str:
    """A text as JSON in ASCII."""
    unit = lambda code: f"format('\\u{{:04x}}', {code})"
    return f"""'"' || array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN c IN ('"', '\\') THEN '\\' || c WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t'
        WHEN c = chr(8) THEN '\\b' WHEN c = chr(12) THEN '\\f' WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN {unit('unicode(c)')}
        ELSE {unit('55296 + ((unicode(c) - 65536) >> 10)')} || {unit('56320 + ((unicode(c) - 65536) & 1023)')} END), '') || '"'"""


_DAY_JSON = """'{"label":null,"probes":[' || string_agg('{"events":' || events || ',"n_valid":' || n_valid || ',"probe":"' || probe || '","rate":' || CAST(rate AS VARCHAR) || ',"tripped":' || CASE WHEN tripped THEN 'true' ELSE 'false' END || '}', ',' ORDER BY probe) || '],"seed":' || id || '}'"""

SQL = {k: duckdb_sql(q) for k, q in {
    "battery_trip": f"WITH {_RESULTS} SELECT judge, probe, events, n_valid, n_items, n_invalid, round(invalid_rate, 9) AS invalid_rate, round(rate, 9) AS rate, round(p, 9) AS p_value, tripped, inconclusive FROM r",
    "parse_verdict_mix": f"WITH {_PARSED} SELECT judge, verdict, count(*) AS n, count(*) FILTER (verdict = bias_side) AS events FROM v GROUP BY ALL",
    "judge_grade": f"""WITH {_RESULTS} SELECT judge, count(*) AS n_probes, count(*) FILTER (tripped) AS n_tripped, CASE WHEN count(*) FILTER (tripped) >= 2 THEN 'FAIL'
        WHEN count(*) FILTER (tripped) = 1 THEN 'NEEDS ATTENTION' WHEN count(*) FILTER (inconclusive AND NOT tripped) > 0 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS grade FROM r GROUP BY judge""",
    "invalid_gate": f"WITH {_RESULTS} SELECT judge, probe, round(invalid_rate, 9) AS invalid_rate, round(p, 9) AS p_value, tripped, inconclusive FROM r WHERE invalid_rate > 0.25",
    "binomial_tails": f"WITH {_COUNTS} SELECT judge, probe, events, n_valid, round({_sf('events', 'n_valid')}, 9) AS sf, round({_cdf('events', 'n_valid')}, 9) AS cdf, round({_sf('events', 'n_valid', '(1.0::DOUBLE / 3)')}, 9) AS sf_third FROM c",
    "two_sided_trip": f"""WITH {_RESULTS} SELECT judge, probe, round(p2, 9) AS p_value, n_valid >= 20 AND p2 < 0.05 AND invalid_rate <= 0.25 AS tripped, inconclusive
        FROM (SELECT *, CASE WHEN n_valid < 20 THEN 1.0 ELSE least(1.0, 2 * least({_sf('events', 'n_valid')}, {_cdf('events', 'n_valid')})) END AS p2 FROM r)""",
    "mock_judges": f"WITH {_MOCK} SELECT u.j AS judge, probe, u.v AS verdict, count(*) AS n FROM y GROUP BY ALL",
    "confusion_3x3": f"WITH {_ONE} SELECT * FROM k",
    "tpr_tnr": f"WITH {_ONE} SELECT judge, probe, tp, fn, tn, fp, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 9) AS tpr, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END, 9) AS tnr FROM q",
    "cohen_kappa": f"WITH {_ONE} SELECT judge, probe, n_scored, round(po, 9) AS po, round(pe, 9) AS pe, round({_K}, 9) AS kappa FROM ({_kappa('q', 'judge, probe, n_scored')})",
    "clopper_pearson": f"""WITH {_ONE} SELECT q.probe, tp, fn, round(a.p, 7) AS tpr_low, round(b.p, 7) AS tpr_high, round(c.p, 7) AS tnr_low, round(d.p, 7) AS tnr_high FROM q
        JOIN {_bisect('q', 'probe', 'tp', 'tp + fn', False)} a USING (probe) JOIN {_bisect('q', 'probe', 'tp', 'tp + fn', True)} b USING (probe)
        JOIN {_bisect('q', 'probe', 'tn', 'tn + fp', False)} c USING (probe) JOIN {_bisect('q', 'probe', 'tn', 'tn + fp', True)} d USING (probe)""",
    "unmatched_labels": f"WITH {_MISSING} SELECT count(*) AS n_labels, count(*) FILTER (verdict IS NULL) AS n_unmatched FROM m",
    "probe_inference": f"WITH l AS ({LABELS}) SELECT regexp_extract(item_id, '^(.*)-[^-]*$', 1) AS inferred, count(*) AS n, count(*) FILTER (regexp_extract(item_id, '^(.*)-[^-]*$', 1) = probe) AS n_same FROM l GROUP BY 1",
    "label_validation": f"""WITH x AS ({LABEL_LINES}) SELECT CASE fault WHEN 0 THEN 'label' WHEN 1 THEN 'labeler_id' WHEN 2 THEN 'timestamp' WHEN 3 THEN 'confidence' WHEN 4 THEN 'confidence'
        WHEN 5 THEN 'probe' WHEN 7 THEN 'record' END AS error, count(*) AS n FROM x GROUP BY 1""",
    "generated_items": f"""WITH b AS ({BANK}), s AS (SELECT probe, count(*) AS size FROM b GROUP BY 1), i AS (SELECT probe, size, unnest(range((SELECT count(*) FROM documents))) AS item_no FROM s)
        SELECT i.probe, count(*) AS n, CAST(sum({len("Question: ") + 1 + len("Answer A:") + 1 + 1 + 1 + len("Answer B:") + 1 + 1 + 1 + len("Which answer is better? Reply with exactly one letter: A or B.")} + length(question) + length(biased) + length(neutral)) AS BIGINT) AS prompt_chars,
        CAST(sum(length(biased)) AS BIGINT) AS biased_chars FROM i JOIN b ON b.probe = i.probe AND b.bank_idx = i.item_no % size GROUP BY 1""",
    "probe_specs": f"""WITH b AS ({BANK}), s AS (SELECT probe, count(*) AS size FROM b GROUP BY 1), i AS (SELECT probe, size, unnest(range((SELECT count(*) FROM documents))) AS item_no FROM s),
        g AS (SELECT i.probe, count(*) AS n, count(*) FILTER (i.probe <> 'fr') AS n_sided, CAST(sum({len("Question: ") + 1 + len("Answer A:") + 1 + 1 + 1 + len("Answer B:") + 1 + 1 + 1 + len("Which answer is better? Reply with exactly one letter: A or B.")} + length(question) + length(biased) + length(neutral)
            + CASE i.probe WHEN 'en' THEN {len("Reviewers chose Answer A, few chose B.") + 1} WHEN 'de' THEN {len("Own or Other?") + 1 + len(" (checked) (not checked)")} ELSE 0 END) AS BIGINT) AS prompt_chars
            FROM i JOIN b ON b.probe = i.probe AND b.bank_idx = (CASE WHEN i.probe = 'fr' THEN item_no // 2 ELSE item_no END) % size GROUP BY 1),
        k AS (SELECT probe, CASE WHEN length(biased) = 0 OR length(neutral) = 0 THEN 'empty' WHEN probe = 'de' AND length(biased) <= length(neutral) THEN 'longer' WHEN probe = 'en' AND greatest(length(biased), length(neutral)) > 2 * least(length(biased), length(neutral)) THEN 'lengths'
            WHEN probe = 'fr' AND contains(lower(neutral), 'quality') THEN 'credential' WHEN probe = 'es' AND regexp_matches(neutral, '{_WORDS}') THEN 'markers' END AS broken FROM b),
        x AS (SELECT probe, count(*) FILTER (broken = 'lengths') AS n_lengths, count(*) FILTER (broken = 'longer') AS n_longer, count(*) FILTER (broken = 'credential') AS n_credential, count(*) FILTER (broken = 'markers') AS n_markers FROM k GROUP BY 1)
        SELECT g.*, n_lengths, n_longer, n_credential, n_markers FROM g JOIN x USING (probe)""",
    "own_and_duplicate_labels": f"""WITH l AS ({LABELS}), t AS (SELECT * FROM l UNION ALL SELECT * FROM l WHERE item_no % 5 = 0),
        d AS (SELECT probe, count(*) AS n_twice, CAST(sum(n) AS BIGINT) AS n_labels FROM (SELECT probe, item_id, labeler_id, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 1) GROUP BY probe),
        o AS (SELECT probe, count(*) AS n_own FROM l WHERE upper(labeler_id) = 'RATER2' GROUP BY probe)
        SELECT probe, coalesce(n_own, 0) AS n_own, coalesce(n_twice, 0) AS n_twice, coalesce(n_labels, 0) AS n_labels FROM o FULL JOIN d USING (probe)""",
    "adjudicate_gold": f"WITH l AS ({LABELS}), {_GOLD} SELECT probe, item_id, gold, n_labelers, round(agreement, 9) AS agreement, tie_broken, unresolved FROM gold",
    "fleiss_kappa": f"""WITH l AS ({LABELS}), n AS (SELECT count(*) AS n, count(*) FILTER (label = 'A') AS a, count(*) FILTER (label = 'B') AS b, count(*) FILTER (label = 'TIE') AS t FROM l GROUP BY probe, item_id HAVING count(*) >= 2),
        s AS (SELECT count(*) AS n_items, avg((a * (a - 1) + b * (b - 1) + t * (t - 1)) / (n * (n - 1))) AS p, (sum(a) / sum(n)) ** 2 + (sum(b) / sum(n)) ** 2 + (sum(t) / sum(n)) ** 2 AS e FROM n)
        SELECT round((p - e) / (1 - e), 9) AS kappa, n_items FROM s""",
    "pairwise_cohen": f"""WITH l AS ({LABELS}), k AS (SELECT x.labeler_id || '|' || y.labeler_id AS pair, count(*) AS n, {_cells('x.label', 'y.label')} FROM l x JOIN l y USING (probe, item_id) WHERE x.labeler_id < y.labeler_id GROUP BY 1)
        SELECT pair, n, round(po, 9) AS po, round(pe, 9) AS pe, round({_K}, 9) AS kappa FROM ({_kappa('k', 'pair, n')})""",
    "labeler_vs_gold": f"""WITH l AS ({LABELS}), {_GOLD}, k AS (SELECT labeler_id, count(*) AS n, {_cells('label', 'gold')} FROM l JOIN gold USING (probe, item_id) GROUP BY 1)
        SELECT labeler_id, n, round(po, 9) AS po, round(pe, 9) AS pe, round({_K}, 9) AS kappa FROM ({_kappa('k', 'labeler_id, n')})""",
    "position_screen": f"""WITH l AS ({LABELS}), c AS (SELECT labeler_id, probe, count(*) AS n, count(*) FILTER (label = 'A') AS n_a FROM l GROUP BY ALL),
        p AS (SELECT *, least(1.0, 2 * least({_sf('n_a', 'n')}, {_cdf('n_a', 'n')})) AS p FROM c)
        SELECT labeler_id, probe, n, n_a, round(n_a / n, 9) AS a_rate, round(p, 9) AS p_value, p < 0.05 AND n >= 5 AS flagged FROM p""",
    "calibrate_multi": f"""WITH l AS ({LABELS}), v AS ({VERDICTS}), {_GOLD}, k AS (SELECT judge, probe, count(*) AS n_labeled, count(*) FILTER (verdict <> 'INVALID') AS n_scored, {_cells('verdict', 'gold')} FROM gold JOIN v USING (probe, item_id) GROUP BY ALL),
        q AS (SELECT *, a_a AS tp, b_a + tie_a AS fn, b_b AS tn, a_b + tie_b AS fp FROM k)
        SELECT judge, probe, n_labeled, n_scored, tp, fn, tn, fp, round({_K}, 9) AS kappa FROM ({_kappa('q', 'judge, probe, n_labeled, n_scored, tp, fn, tn, fp')})""",
    "label_coverage": f"""WITH l AS ({LABELS}), v AS ({VERDICTS_WITH_GAPS}), {_GOLD} SELECT count(*) FILTER (verdict IS NOT NULL) AS n_items, count(*) FILTER (verdict IS NOT NULL AND unresolved) AS n_unresolved,
        CAST(coalesce(sum(n_labelers) FILTER (verdict IS NULL), 0) AS BIGINT) AS n_unmatched FROM gold LEFT JOIN v USING (probe, item_id)""",
    "self_consistency": f"""WITH r AS ({RESCORES}), v AS ({VERDICTS}), b AS (SELECT probe, CASE WHEN swapped AND r.verdict IN ('A', 'B') THEN translate(r.verdict, 'AB', 'BA') ELSE r.verdict END = v.verdict AS same
            FROM r JOIN v USING (probe, item_id) WHERE r.verdict <> 'INVALID'),
        q AS (SELECT probe, coalesce(probe, '') AS key, count(*) AS n0, count(*) FILTER (same) AS n_same FROM b GROUP BY ROLLUP (probe))
        SELECT probe, n0 AS n, n_same, round(n_same / n0, 7) AS consistency, round(x.p, 7) AS low, round(y.p, 7) AS high FROM q
        JOIN {_bisect('q', 'key', 'n_same', 'n0', False)} x USING (key) JOIN {_bisect('q', 'key', 'n_same', 'n0', True)} y USING (key)""",
    "unswapped_verdicts": f"WITH r AS ({RESCORES}) SELECT probe, CASE WHEN swapped AND verdict IN ('A', 'B') THEN translate(verdict, 'AB', 'BA') ELSE verdict END AS verdict, count(*) AS n FROM r GROUP BY ALL",
    "replay_join": f"""WITH p AS (SELECT *, sha256(system || chr(0) || user) AS k FROM ({PROMPTS})), r AS ({REPLIES}), raw AS (SELECT a.probe, r.verdict AS raw FROM p a JOIN p b ON a.k = b.k JOIN r ON r.id = b.id),
        {_PARSED.split(", v AS ", 1)[1].join(["v AS ", ""])} SELECT probe, verdict, count(*) AS n FROM v GROUP BY ALL""",
    "weekly_snapshots": f"WITH {_WEEKS} SELECT week, probe, n_valid, CAST(events AS BIGINT) AS events, round(rate, 9) AS rate, round(p_value, 9) AS p_value, tripped, inconclusive FROM s",
    "fisher_weeks": f"WITH {_DRIFT} SELECT week, probe, round(rate_a, 9) AS rate_a, round(rate_b, 9) AS rate_b, round(delta, 9) AS delta, round(fisher_p, 9) AS fisher_p FROM z",
    "holm_reject": f"WITH {_DRIFT} SELECT week, probe, holm_significant FROM z",
    "drift_alerts": f"""WITH {_DRIFT} SELECT week, probe, status, trip_flip, alert, concat_ws('; ', CASE WHEN trip_flip THEN 'trip_flip' END, CASE WHEN shift THEN 'rate_shift' END) AS alert_reason, watch,
        CASE WHEN watch THEN CASE WHEN holm_significant THEN 'sub-gate shift' ELSE 'near-bar shift' END ELSE '' END AS watch_reason FROM z""",
    "drift_summary": f"""WITH {_DRIFT} SELECT week, count(*) AS n_compared, count(*) FILTER (alert) AS n_alerts, coalesce(string_agg(CAST(probe AS VARCHAR), ',' ORDER BY probe) FILTER (alert), '') AS alerting,
        count(*) FILTER (trip_flip) AS n_trip_flips, count(*) FILTER (watch) AS n_watch, coalesce(string_agg(CAST(probe AS VARCHAR), ',' ORDER BY probe) FILTER (watch), '') AS watching FROM z GROUP BY week""",
    "chain_verify": _CHAIN,
    "snapshots_since": f"WITH d AS ({DAYS}), t AS (SELECT CAST(id AS INT) AS id, '2024-01-' || lpad(CAST(id + 1 AS VARCHAR), 2, '0') AS ts FROM d) SELECT *, id = min(id) OVER () AS is_baseline, id = max(id) OVER () AS is_target FROM t WHERE ts >= '2024-01-15'",
    "baseline_current": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS baseline, count(*) AS n_pins FROM events WHERE event_type = 'click' GROUP BY user_id",
    "power_table": f"""WITH {_BARS} SELECT judge, probe, c.n_valid, critical, true_rate, round(CASE WHEN c.n_valid < 20 THEN 0.0 ELSE {_sf('critical', 'c.n_valid', 'true_rate')} END, 9) AS power
        FROM c JOIN b USING (n_valid), (SELECT unnest({[float(x) for x in TRUE_RATES]}::DOUBLE[]) AS true_rate)""",
    "flip_rates": f"""WITH {_BARS}, r AS (SELECT judge, probe, events, n_valid, critical, events / n_valid AS rate FROM c JOIN b USING (n_valid) WHERE n_valid > 0),
        o AS (SELECT *, CASE WHEN rate IN (0, 1) THEN CASE WHEN events >= critical THEN 1.0 ELSE 0.0 END ELSE {_sf('critical', 'n_valid', 'rate')} END AS over_bar FROM r),
        l AS (SELECT *, unnest(range(0, events + 1)) AS lost FROM r), w AS (SELECT judge, probe, lost, unnest(range(0, n_valid - events + 1)) AS won FROM l WHERE lost < 60),
        s AS (SELECT judge, probe, sum(CASE WHEN (events - lost + won >= critical) <> (events >= critical) THEN ({_point('lost', 'events', FLIPS)}) * ({_point('won', '(n_valid - events)', FLIPS)}) ELSE 0.0 END) AS p
            FROM l JOIN w USING (judge, probe, lost) WHERE won < 60 GROUP BY ALL)
        SELECT judge, probe, round(CASE WHEN n_valid < 20 THEN 0.0 WHEN events >= critical THEN 1 - over_bar ELSE over_bar END, 9) AS p_other_items, round(CASE WHEN n_valid < 20 THEN 0.0 ELSE p END, 9) AS p_same_items FROM o JOIN s USING (judge, probe)""",
    "canonical_chain": f"""WITH RECURSIVE days AS (SELECT id, {_DAY_JSON} AS record FROM ({DAY_PROBES}) GROUP BY id), o AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM days),
        ch AS (SELECT id, k, sha256('GENESIS' || record) AS chain_hash FROM o WHERE k = 1 UNION ALL SELECT o.id, o.k, sha256(ch.chain_hash || o.record) FROM ch JOIN o ON o.k = ch.k + 1) SELECT id, chain_hash, id <> 5 AS ok FROM ch""",
    "canonical_records": f"""SELECT doc_id, sha256('{{"about":{{"even":' || CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END || ',"source":' || {_json('source')} || ',"weeks":' || CAST(n_chars / 7.0::DOUBLE AS VARCHAR) || '}},"lang":' || {_json('lang')} ||
        ',"numbers":[0.1,' || CAST(doc_id * 1e14::DOUBLE AS VARCHAR) || '],"text":' || {_json('text')} || '}}') AS sha256 FROM documents""",
    "timestamp_forms": f"SELECT form, count(*) AS n, count(*) FILTER (form < 8) AS n_valid FROM ({STAMPS}) GROUP BY form",
    "judge_coverage": f"""WITH l AS ({LABELS}), v AS ({JUDGES}), {_GOLD}, j AS (SELECT DISTINCT judge FROM v),
        x AS (SELECT judge, probe, count(*) AS n_labels, count(*) FILTER (v.item_id IS NULL) AS n_unmatched FROM j CROSS JOIN l LEFT JOIN v USING (judge, probe, item_id) GROUP BY GROUPING SETS ((judge, probe), (judge))),
        y AS (SELECT judge, probe, count(v.item_id) AS n_items, count(*) FILTER (v.item_id IS NOT NULL AND unresolved) AS n_unresolved, CAST(coalesce(sum(n_labelers) FILTER (v.item_id IS NULL), 0) AS BIGINT) AS n_votes_unmatched
            FROM j CROSS JOIN gold LEFT JOIN v USING (judge, probe, item_id) GROUP BY GROUPING SETS ((judge, probe), (judge)))
        SELECT x.judge, x.probe, n_labels, n_unmatched, n_items, n_unresolved, n_votes_unmatched FROM x JOIN y ON x.judge = y.judge AND x.probe IS NOT DISTINCT FROM y.probe""",
    "judge_consistency": f"""WITH r AS ({JUDGES_AGAIN}), v AS ({JUDGES}), b AS (SELECT judge, probe, CASE WHEN swapped AND r.verdict IN ('A', 'B') THEN translate(r.verdict, 'AB', 'BA') ELSE r.verdict END = v.verdict AS same
            FROM r JOIN v USING (judge, probe, item_id) WHERE r.verdict <> 'INVALID'),
        q AS (SELECT judge, probe, concat(judge, ':', coalesce(probe, '')) AS key, count(*) AS n0, count(*) FILTER (same) AS n_same FROM b GROUP BY GROUPING SETS ((judge, probe), (judge)))
        SELECT judge, probe, n0 AS n, n_same, round(n_same / n0, 7) AS consistency, round(x.p, 7) AS low, round(y.p, 7) AS high FROM q
        JOIN {_bisect('q', 'key', 'n_same', 'n0', False)} x USING (key) JOIN {_bisect('q', 'key', 'n_same', 'n0', True)} y USING (key)""",
    "stream_weeks": f"""WITH s AS ({STREAM}), w AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start FROM s),
        i AS (SELECT start, judge, run, probe, item_id, arg_min(raw, (ts, raw)) AS raw, any_value(bias_side) AS bias_side FROM w WHERE start + INTERVAL 8 DAY <= (SELECT max(ts) FROM w) GROUP BY ALL),
        c AS (SELECT start, judge, run, probe, count(*) AS n_items, count(*) FILTER (raw <> 'unclear') AS n_valid, count(*) FILTER (right(trim(raw, '.'), 1) = bias_side AND raw <> 'unclear') AS events FROM i GROUP BY ALL),
        t AS (SELECT *, (n_items - n_valid) / n_items AS invalid_rate, CASE WHEN n_valid > 0 THEN events / n_valid ELSE 0.0 END AS rate, CASE WHEN n_valid < 20 THEN 1.0 ELSE {_sf('events', 'n_valid')} END AS p FROM c)
        SELECT strftime(start, '%Y-%m-%d') AS start, judge, run, probe, n_items, n_valid, events, round(invalid_rate, 9) AS invalid_rate, round(rate, 9) AS rate, round(p, 9) AS p_value,
        n_valid >= 20 AND p < 0.05 AND invalid_rate <= 0.25 AS tripped, n_valid < 20 OR invalid_rate > 0.25 AS inconclusive FROM t""",
    "baselines_as_of": f"""WITH s AS ({SHOTS}), p AS (SELECT judge, ts, max(baseline_id) AS baseline_id FROM ({PINS}) GROUP BY ALL), f AS (SELECT judge, min(id) AS first_id FROM s GROUP BY 1)
        SELECT s.id, s.judge, s.ts, coalesce(p.baseline_id, f.first_id) AS baseline_id FROM s ASOF LEFT JOIN p ON s.judge = p.judge AND s.ts >= p.ts JOIN f ON f.judge = s.judge""",
    "blinded_set": f"""SELECT probe, count(*) AS n, count(DISTINCT item_id) AS n_items, CAST(sum(length(answer_a) + length(answer_b)) AS BIGINT) AS chars, max(sha256(answer_a || answer_b)) AS last_answers,
        CAST(0 AS BIGINT) AS gaps FROM ({ITEMS}) GROUP BY probe""",
}.items()}
