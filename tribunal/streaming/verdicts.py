"""Verdicts as a stream: counted by run, probe and window as they come, compared with a baseline and kept in the ledger when a window closes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate
from ..functions.verdicts import is_event, parse_verdict
from ..operators.battery import probe_results
from ..operators.drift import compare

RUN = ["judge", "run", "probe"]


def windowed_counts(verdicts: DataFrame, late: str = "1 day", width: str = "7 days") -> DataFrame:
    """start, judge, run, probe, n_items, n_valid, events and invalid_rate, from verdicts (ts, judge, run, probe, item_id, bias_side, raw). Works on batches, too.

    Runs repeat the ids of items: an item counts once in each run and window, by its earliest verdict (of equal times, the one of the least text), however
    often it is delivered. In a stream, a window of a run is counted when the latest time seen is `late` after its end; what comes after that is dropped.
    """
    if verdicts.isStreaming:
        verdicts = verdicts.withWatermark("ts", late)
    item = verdicts.groupBy(F.window("ts", width), *RUN, "item_id").agg(F.min(F.struct("ts", "raw", "bias_side")).alias("first"))
    parsed = item.select("window", *RUN, parse_verdict(F.col("first.raw")).alias("verdict"), F.col("first.bias_side").alias("bias_side"))
    counts = parsed.groupBy("window", *RUN).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("verdict") != "INVALID").alias("n_valid"), F.count_if(is_event()).alias("events"))
    return counts.select(F.col("window.start").alias("start"), *RUN, "n_items", "n_valid", "events", rate(F.col("n_items") - F.col("n_valid"), "n_items").alias("invalid_rate"))


def watch(counts: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, ledger=None, baseline: DataFrame | None = None, source: str = "watch", **trigger):
    """Start a query that gives `sink` the results of each closed window's runs, their drift, and the number of the batch.

    Baselines are probe results: `baseline` (probe, n_valid, events, tripped, inconclusive; the same for all judges), or what the ledger had pinned for the
    judge when the window began (else the judge's first snapshot). With a ledger, each run of a window becomes a snapshot after `sink` returned. A batch that
    is repeated after a failure comes under the same number, and is appended to the ledger once; `source` names this query there.
    """

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        by = ["start", "judge", "run"]
        results = probe_results(batch).withColumns({"n_invalid": F.col("n_items") - F.col("n_valid"), "ts": F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss")}).persist()
        try:
            if ledger is None:
                drift = compare(baseline, results, by)
            else:
                drift = compare(ledger.baseline_results(results.select(*by, "ts").distinct()), results, by, on=by)
            sink(results, drift, number)
            if ledger is not None:
                ledger.append_runs(results, source, number)
        finally:
            results.unpersist()

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()
