"""The snapshot ledger: append-only Parquet with a hash chain, and a log of baselines. One writer at a time: the second of two with the same id fails.

Each append is a folder of its own: named by id, or by source and batch, which a repeated batch finds done (or, if it broke off, writes again).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..operators.asof import as_of
from ..operators.battery import grades
from ..operators.drift import compare

PROBE = """struct<probe: string, version: string, expected_direction: string, n_items: long, n_valid: long, n_invalid: long, events: long, rate: double, p_value: double, alpha: double,
    two_sided: boolean, tripped: boolean, inconclusive: boolean, invalid_rate: double, seed: long, min_n: long, reason: string>"""
FIELDS = [x.strip().split(":")[0] for x in PROBE.removeprefix("struct<").split(",")]
SNAPSHOTS = f"id long, ts string, judge string, protocol_sha256 string, seed long, n long, grade string, label string, probes array<{PROBE}>, format int, chain_hash string"
#: What the chain covers: all that is stored. Snapshots without a format are from before that, and have a few fields covered. Those of the common form are
#: under the digest of a canonical JSON text, as other tools write it.
FORMAT, COMMON = 2, 0
COVERED = ("id", "ts", "judge", "protocol_sha256", "seed", "n", "grade", "label", "format")
BASELINES = "seq long, ts string, old_id long, new_id long, reason string"
GENESIS = "GENESIS"


def common_record() -> Column:
    """The text of a snapshot in the common form. Its names, and that the chain starts from GENESIS."""
    probes = F.transform(F.array_sort("probes"), lambda p: F.struct(p["probe"].alias("probe_name"), *[p[c].alias(c) for c in FIELDS[1:]]))
    whole = F.struct("ts", F.col("judge").alias("adapter_name"), "protocol_sha256", "seed", "n", "grade", "label", probes.alias("probes"))
    return canonical_json(whole, f"struct<ts: string, adapter_name: string, protocol_sha256: string, seed: long, n: long, grade: string, label: string, probes: array<{PROBE.replace('probe:', 'probe_name:', 1)}>>")


def record() -> Column:
    """The text of a snapshot that the chain covers: its fields, and its probes in order of name; nulls are told from empty texts."""
    whole = F.to_json(F.struct(*COVERED, F.array_sort("probes").alias("probes")), {"ignoreNullFields": "false"})
    field = lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("-"))
    probes = F.transform(F.array_sort("probes"), lambda p: F.concat_ws(":", *[field(p[c]) for c in ("probe", "n_items", "n_valid", "events", "tripped", "inconclusive")]))
    first = F.concat_ws("|", *[field(F.col(c)) for c in ("id", "ts", "judge", "protocol_sha256", "seed", "grade", "label")], F.array_join(probes, ","))
    return F.when(F.col("format").isNull(), first).when(F.col("format") == COMMON, common_record()).otherwise(whole)


def chained(previous: Column, text: Column) -> Column:
    return F.sha2(F.concat(previous, text), 256)


def in_order(rows: DataFrame, key: str = "id") -> DataFrame:
    """rows with __nth, from 1 on, in the order of a whole-number key: ranges of 4096 keys are numbered by themselves, after the counts of those before."""
    rows = rows.withColumn("__part", F.shiftright(F.col(key).cast("long"), 12))
    before = rows.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return rows.withColumn("__own", nth).join(before.drop("count"), "__part").withColumn("__nth", F.col("__before") + F.col("__own")).drop("__part", "__before", "__own")


def verify_chain(snapshots: DataFrame, text: Column | None = None) -> DataFrame:
    """id, ok: whether chain_hash is that of the record after the one before it. Each link is looked at by itself, beside its predecessor."""
    rows = in_order(snapshots.withColumn("__text", record() if text is None else text))
    before = rows.select((F.col("__nth") + 1).alias("__nth"), F.col("chain_hash").alias("__previous"))
    return rows.join(before, "__nth", "left").select("id", (F.col("chain_hash") == chained(F.coalesce("__previous", F.lit(GENESIS)), F.col("__text"))).alias("ok"))


def baselines_as_of(snapshots: DataFrame, pins: DataFrame, first: DataFrame) -> DataFrame:
    """snapshots (judge, ts and more) with baseline_id, from pins (judge, ts, seq, baseline_id): the last one by then, else the judge's least id in first (id, judge)."""
    day = lambda ts: F.substring(ts.cast("string"), 1, 10)
    found = as_of(snapshots, pins, ["judge"], "ts", "baseline_id", day, "seq")
    least = first.groupBy("judge").agg(F.min("id").alias("__first"))
    return found.join(least, "judge", "left").withColumn("baseline_id", F.coalesce("baseline_id", "__first")).drop("__first")


def from_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots of a ledger that another tool keeps in SQLite, in the common form, as rows that verify_chain takes. Such files are small."""
    import contextlib
    import json
    import sqlite3

    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        rows = db.execute("SELECT id, ts, adapter_name, protocol_sha256, seed, n, grade, label, probes_json, chain_hash FROM snapshots ORDER BY id").fetchall()
    whole = lambda p: {"probe": p["probe_name"], **{c: float(p[c]) if c in ("rate", "p_value", "alpha", "invalid_rate") and p[c] is not None else p[c] for c in FIELDS[1:]}}
    return spark.createDataFrame([(*r[:8], [whole(p) for p in json.loads(r[8])], COMMON, r[9]) for r in rows], SNAPSHOTS)


def linked(rows: DataFrame, previous: str) -> DataFrame:
    """rows (id, text and more) with chain_hash, from the hash before them on: one task goes along the chain, with a hash in memory."""
    at = [c for c in rows.columns if c != "__text"]

    def link(batches):
        last = previous
        for b in batches:
            out = []
            for text in b.column("__text").to_pylist():
                last = hashlib.sha256((last + text).encode()).hexdigest()
                out.append(last)
            yield pa.RecordBatch.from_arrays([*map(b.column, at), pa.array(out, pa.string())], [*at, "chain_hash"])

    schema = rows.select(*at).withColumn("chain_hash", F.lit("")).schema
    return rows.repartition(1).sortWithinPartitions("id").mapInArrow(link, schema)


class Taken(RuntimeError):
    """Another writer has appended under this id."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], schema)

    def snapshots(self, since: str | None = None) -> DataFrame:
        """In order of id; `since` compares the texts of ts."""
        rows = self._read("snapshots", SNAPSHOTS)
        return (rows.where(F.col("ts") >= since) if since else rows).orderBy("id")

    def snapshot(self, id_: int) -> DataFrame:
        row = self._read("snapshots", SNAPSHOTS).where(F.col("id") == id_)
        if row.isEmpty():
            raise KeyError(id_)
        return row

    def append(self, results: DataFrame, *, ts: str, judge: str, protocol_sha256: str | None, seed: int, grade: str, label: str | None = None, n: int | None = None) -> int:
        """Add a snapshot of probe results, with those of FIELDS that they have; returns its id."""
        last = self._read("snapshots", SNAPSHOTS).agg(F.max("id").alias("id"), F.max_by("chain_hash", "id").alias("hash")).first()
        id_ = (last.id or 0) + 1
        kept = F.struct(*[F.col(c) if c in results.columns else F.lit(None).alias(c) for c in FIELDS])
        rows = results.agg(F.array_sort(F.collect_list(kept)).cast(f"array<{PROBE}>").alias("probes"))
        fields = {"id": id_, "ts": ts, "judge": judge, "protocol_sha256": protocol_sha256, "seed": seed, "n": n, "grade": grade, "label": label, "format": FORMAT}
        kinds = {f.name: f.dataType for f in self._read("snapshots", SNAPSHOTS).schema.fields}
        row = rows.withColumns({k: F.lit(v).cast(kinds[k]) for k, v in fields.items()}).withColumn("chain_hash", chained(F.lit(last.hash or GENESIS), record()))
        try:
            row.select(*kinds).write.parquet(f"{self.path}/snapshots/{id_:012d}")
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise Taken(f"snapshot {id_} is there") from e
            raise
        return id_

    def append_runs(self, results: DataFrame, source: str, batch: int, *, protocol_sha256: str | None = None, seed: int = 0) -> bool:
        """Add a snapshot for each run among probe results (ts, judge, run and those of FIELDS), in order of ts, judge and run; run is its label.

        source and batch name the append: the same again changes nothing (and gives False), and one that broke off is written anew.
        """
        path = f"{self.path}/snapshots/{hashlib.sha256(source.encode()).hexdigest()[:16]}-{batch:012d}"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        at = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p)
        if fs.exists(at(f"{path}/_SUCCESS")):
            return False
        fs.delete(at(path), True)
        last = self._read("snapshots", SNAPSHOTS).agg(F.max("id").alias("id"), F.max_by("chain_hash", "id").alias("hash")).first()
        by = ["ts", "judge", "run"]
        kept = F.struct(*[F.col(c) if c in results.columns else F.lit(None).alias(c) for c in FIELDS])
        runs = results.groupBy(*by).agg(F.array_sort(F.collect_list(kept)).cast(f"array<{PROBE}>").alias("probes"), F.max("n_items").alias("n")).join(grades(results, by).select(*by, "grade"), by)
        nth = F.row_number().over(Window.orderBy(*by)) + (last.id or 0)  # the runs of a batch
        kinds = {f.name: f.dataType for f in self._read("snapshots", SNAPSHOTS).schema.fields}
        fields = {"id": nth, "protocol_sha256": F.lit(protocol_sha256), "seed": F.lit(seed), "label": F.col("run"), "format": F.lit(FORMAT)}
        runs = runs.withColumns(fields).select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items() if c != "chain_hash"]).withColumn("__text", record())
        linked(runs, last.hash or GENESIS).select(*kinds).write.parquet(path)
        return True

    def pin(self, new_id: int, *, ts: str, reason: str) -> None:
        self.snapshot(new_id)
        log = self._read("baselines", BASELINES)
        last = log.agg(F.max("seq").alias("seq"), F.max_by("new_id", "seq").alias("id")).first()
        self.spark.createDataFrame([((last.seq or 0) + 1, ts, last.id, new_id, reason)], BASELINES).write.mode("append").parquet(f"{self.path}/baselines")

    def baseline(self) -> int | None:
        return self._read("baselines", BASELINES).agg(F.max_by("new_id", "seq")).first()[0]

    def baselines_of(self, snapshots: DataFrame | None = None) -> DataFrame:
        """snapshots (judge, ts and more; all of the ledger unless given) with baseline_id: what was pinned last for the judge by then, else its first snapshot."""
        own = self._read("snapshots", SNAPSHOTS)
        pins = self._read("baselines", BASELINES).join(own.select(F.col("id").alias("new_id"), "judge"), "new_id")
        return baselines_as_of(own.select("id", "judge", "ts") if snapshots is None else snapshots, pins.select("judge", "ts", "seq", F.col("new_id").alias("baseline_id")), own.select("id", "judge"))

    def baseline_results(self, comparisons: DataFrame) -> DataFrame:
        """comparisons (judge, ts and more) with the probe results of their baselines (see baselines_of); none where the judge has no snapshot."""
        probes = self._read("snapshots", SNAPSHOTS).select(F.col("id").alias("baseline_id"), F.explode("probes").alias("p"))
        return self.baselines_of(comparisons).join(probes, "baseline_id").select(*comparisons.columns, "p.*")

    def history(self) -> DataFrame:
        """The drift of each snapshot against its judge's baseline of the time: id, judge, ts, baseline_id and drift.compare's columns; another protocol isn't compared."""
        of = self.baselines_of().where("baseline_id <> id")
        probes = self._read("snapshots", SNAPSHOTS).select("id", "protocol_sha256", F.explode("probes").alias("p")).select("id", "protocol_sha256", "p.*")
        now = of.join(probes, "id")
        then = of.select("id", "baseline_id").join(probes.withColumnRenamed("id", "baseline_id"), "baseline_id")
        same = now.select("id", "protocol_sha256").distinct().join(then.select("id", F.col("protocol_sha256").alias("__then")).distinct(), "id").where(F.col("protocol_sha256").eqNullSafe(F.col("__then"))).select("id")
        rows = compare(then.join(same, "id", "left_semi"), now.join(same, "id", "left_semi"), ["id"], on=["id"])
        return of.join(rows, "id")

    def choose(self, since: str | None = None, baseline: int | None = None, target: int | None = None) -> tuple[int, int]:
        """Baseline (asked for, pinned, or earliest) and target (asked for, or latest) among the snapshots since then."""
        ends = self.snapshots(since).agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
        pinned = self.baseline()
        first = next((x for x in (baseline, pinned, ends["first"]) if x is not None), None)
        last = target if target is not None else ends["last"]
        if first is None or last is None:
            raise KeyError("no snapshots")
        return first, last

    def verify(self) -> list[int]:
        """ids at which the chain is broken."""
        return [r.id for r in verify_chain(self._read("snapshots", SNAPSHOTS)).where("NOT ok").orderBy("id").collect()]
