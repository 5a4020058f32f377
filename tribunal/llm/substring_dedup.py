"""Substring deduplication of word windows, over a log-structured index of fingerprints.

The index is a set of immutable runs, sorted by anchor hash (runs.py): a new batch's fingerprints (see repeats.py) become a run, which is merge-joined with
the runs of history as they lie; what repeats, in the batch or between it and history, is added to the index's list of matches. Several runs are compacted
into one. Documents then take what concerns them from the matches. Matches are verified by a second, unrelated hash of the stretches' words; where these
differ, and at the ends of stretches, single windows are compared by hashes of their own.

Null text: no words. Repeated rows are repeats of each other, so windows in both go. Texts under 35 words, and empty tables, are fine. A null doc_id
stays null. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, remove, scratch, shared_dir, staged, table, write
from .repeats import SOURCE, UNCLEAR, Repeats, fingerprints, marks_of, once, scanned_sums, tied, without_repeats
from .runs import SortedRuns

WORDS = Repeats("word", 35, 8, first_stays=False)
_MATCHES = "a long, h long, own long, other long, whole int, ends int, check long"


class FingerprintIndex:
    """Runs, and the matches found between them, under `path`. A batch is added by compacting `most` runs first."""

    def __init__(self, spark: SparkSession, path: str, spec: Repeats = WORDS, most: int = 4):
        self.spark, self.path, self.spec, self.most, self.runs = spark, path, spec, most, SortedRuns(spark, path, spec.schema)

    def add(self, docs: DataFrame) -> None:
        """Fingerprints of history are read, its texts are not."""
        if len(self.runs.live) >= self.most:
            self.compact()
        run = self.runs.store(fingerprints(tied(docs), self.spec))
        # matches are those of a step, and count once that step is in the log: a batch that failed leaves none
        write(scanned_sums(self.runs.beside(self.runs.table(run[1]))), f"{self.path}/matches/{self.runs.step + 1}", "overwrite")
        self.runs.commit([*self.runs.live, run])

    def compact(self) -> None:
        remove(self.spark, f"{self.path}/matches/{self.runs.step + 1}")  # of a batch that failed
        self.runs.merge(self.runs.live)

    def matches(self) -> DataFrame:
        """Those of all steps in the log, of which merges have none."""
        paths = [p for k in range(1, self.runs.step + 1) if exists(self.spark, p := f"{self.path}/matches/{k}")]
        return self.spark.read.schema(_MATCHES).parquet(*paths) if paths else self.spark.createDataFrame([], _MATCHES)

    def wanted(self, marks: DataFrame, found: DataFrame) -> DataFrame:
        """(tie, h, bits) of rows without these marks that hold what those with them may repeat: one of each stretch of their anchors."""
        near = found.join(marks.select("a").distinct(), "a", "left_semi")
        only = lambda bits: bits.bitwiseAND(F.lit(UNCLEAR | SOURCE)).alias("bits")
        one = near.select(F.col("own").alias("tie"), "h", only(F.col("whole").bitwiseOR(F.col("ends"))))
        two = near.where("other <> own").select(F.col("other").alias("tie"), "h", only(F.col("whole")))
        return one.unionByName(two).where("bits > 0").join(marks.select("tie").distinct(), "tie", "left_anti")

    def remove_repeats(self, docs: DataFrame, history: DataFrame | None = None, text: bool = False) -> DataFrame:
        """doc_id, n_units, n_removed, n_spans, kept_sha256 and (with text) kept of docs: all that were added, or some, with all others as history."""
        with scratch(self.spark) as folders:
            stage = lambda df, name: staged(df, name, folders)
            rows, found = tied(docs), self.matches()
            own, again = once(rows, stage)
            marks = stage(marks_of(own, found, self.spec), "marks")
            others = None if history is None else (tied(history), self.wanted(marks, found), ["tie"])
            out = without_repeats(rows, own, again, marks, others, self.spec, text, stage)
            return staged(out if text else out.drop("kept"), "kept")


def op9_substring_dedup(spark, sf_dir: str, batches: int = 3) -> DataFrame:
    """All documents, as batches by a hash of doc_id, the last of which finds its history compacted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
    index = FingerprintIndex(spark, path, most=batches - 1)
    try:
        for k in range(batches):
            index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
        out = index.remove_repeats(docs)
    finally:
        index.runs.drop()
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


#: Hashes of windows, since whole ones would need too much memory.
SQL_OP9 = """WITH
d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT rid, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS g FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS x FROM r),
l AS (SELECT rid, list(x) AS gone FROM c GROUP BY rid),
k AS (SELECT d.rid, string_agg(d.w[j.i], ' ' ORDER BY j.i) AS kept FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS i) j
    LEFT JOIN c ON c.rid = d.rid AND c.x = j.i WHERE c.x IS NULL GROUP BY d.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (rid) LEFT JOIN k USING (rid)"""

QUERIES = {"op9_substring_dedup": op9_substring_dedup}
SQL = {"op9_substring_dedup": SQL_OP9}
