"""Immutable sorted runs of fingerprints in the shared folder, and the log that says which of them are live.

A run is a Parquet table, bucketed by `a` and sorted by (a, h) within a bucket, one file each. All runs of an index have the same
buckets, so that Spark joins and merges them bucket by bucket, without a shuffle. Runs are never changed: a merge writes a new one. The log is a Parquet
table to which each change appends all live runs under the next step; an index opened again, in another session too, goes on from its last step.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaning, remove, write

#: a: hash of an anchor, h: of the stretch around it. Either a row for each row of documents that has it (doc_id, tie: its key), or sums: n: how often it
#: occurs; first and last: the least and the greatest key of a row that has it; low and high: of the second hashes of its stretches. Sums of an (a, h) may
#: stand in several rows, one for each task that met it.
ROWS = "a long, h long, doc_id long, tie long"
SUMS = "a long, h long, n long, first long, last long, low long, high long"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
LOG = "step long, run string, n_rows long, buckets int"


class SortedRuns:
    """The live runs under `path`, largest first, as (rows, name)."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema, self.live, self.step, self.made = spark, path, schema, [], 0, set()
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        try:
            log = spark.read.schema(LOG).parquet(f"{path}/log")
            last = log.where(F.col("step") == log.select(F.max("step")).scalar()).collect()  # a handful of rows
        except AnalysisException:  # a new index
            last = []
        if last:
            self.step, self.buckets = last[0].step, last[0].buckets
            self.live = sorted(((r.n_rows, r.run) for r in last), reverse=True)

    def table(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # new, or written by another session
            columns = self.schema.replace(" long", " BIGINT")
            self.spark.sql(f"""CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd', `parquet.writer.version` 'v2')
                CLUSTERED BY (a) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'""")
        return self.spark.table(name)

    def store(self, rows: DataFrame) -> tuple[int, str]:
        """Write a run; it isn't live yet. It is sorted before it is written, since Spark would sort by the bucket's number first, which is one per task."""
        name = f"run_{uuid.uuid4().hex}"
        self.made.add(name)
        self.table(name)
        rows = rows.select(*[c.split()[0] for c in self.schema.split(", ")]).repartition(self.buckets, "a").sortWithinPartitions("a", "h")
        before = self.spark.conf.get(WRITERS)
        self.spark.conf.set(WRITERS, "2")  # then no other order is asked for
        try:
            with cleaning(self.spark):
                rows.write.insertInto(name)
        finally:
            self.spark.conf.set(WRITERS, before)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").count(), name

    def commit(self, live: list[tuple[int, str]]) -> None:
        """Make these the live runs; the files of the others go after that."""
        gone = {n for _, n in self.live} - {n for _, n in live}
        self.step += 1
        write(self.spark.createDataFrame([(self.step, n, rows, self.buckets) for rows, n in live], LOG).coalesce(1), f"{self.path}/log", "append")
        self.live = sorted(live, reverse=True)
        for n in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            remove(self.spark, f"{self.path}/{n}")

    def drop(self) -> None:
        """Remove the index: its runs, also those that a failure left behind, and its folder."""
        made = {n for _, n in self.live} | self.made
        for n in made:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
        self.live, self.made = [], set()
        remove(self.spark, self.path)

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """The rows of runs, bucket by bucket, without a shuffle. Spark keeps a union's buckets if its first part is dealt like them, so that part is one row, without h."""
        nothing = self.spark.range(1).selectExpr("id AS a").repartition(self.buckets, "a")
        out = nothing.select([F.col(c) if c == "a" else F.lit(None).cast(kind).alias(c) for c, kind in tables[0].dtypes])
        for t in tables:
            out = out.unionByName(t)
        return out

    def merge(self, some: list[tuple[int, str]]) -> None:
        """One run in place of some."""
        merged = self.store(self.together([self.table(n) for _, n in some]).where("h IS NOT NULL"))
        self.commit([*[x for x in self.live if x not in some], merged])

    def beside(self, new: DataFrame) -> DataFrame:
        """The rows of the run `new` (is_new) together with those of all live runs."""
        return self.together([new.withColumn("is_new", F.lit(True)), *[self.table(n).withColumn("is_new", F.lit(False)) for _, n in self.live]])
