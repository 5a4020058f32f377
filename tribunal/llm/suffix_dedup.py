"""Suffix-array deduplication of byte strings, over a logarithmic family of sorted levels.

A level is a sorted table of sampled suffixes: one suffix per group of byte windows (see repeats.py), in the order of the hash of its first bytes, with
the hash of the stretch its windows cover and its documents. (A whole suffix array takes eight bytes and more for each byte of text, beyond any sensible
budget of disk; the sample is enough to find every repeated window, and what it leaves unclear is decided window by window.)

A new batch gets such a table; it is scanned side by side with the levels of earlier batches, which gives the long matches of the batch, in itself and with
history; then it becomes a level. Before the next batch, levels within a factor of two of each other merge, so that n batches leave about log n levels.
What earlier batches lost doesn't change any more. Levels and their list are in the shared folder (runs.py).

Null text: empty, nothing is removed. A null doc_id counts as larger than any. Rows that share a doc_id don't remove bytes of each other. Texts under
50 bytes, and empty tables, are fine. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, scratch, shared_dir, staged, table
from .repeats import Repeats, fingerprints, once, scanned_rows, tied, without_repeats
from .runs import SortedRuns

BYTES = Repeats("byte", 50, 24, first_stays=True)


class SuffixLevels:
    """Levels under `path`."""

    def __init__(self, spark: SparkSession, path: str, spec: Repeats = BYTES):
        self.spark, self.spec, self.levels = spark, spec, SortedRuns(spark, path, spec.schema)

    def _settle(self) -> None:
        """Merge the two smallest levels as long as they are within a factor of two."""
        while len(live := self.levels.live) > 1 and live[-2][0] < 2 * max(1, live[-1][0]):
            self.levels.merge(live[-2:])

    def add(self, docs: DataFrame, history: DataFrame | None = None, text: bool = False) -> DataFrame:
        """The batch docs becomes a level; doc_id, n_units, n_removed, n_spans, kept_sha256 and (with text) kept of each of its rows.

        history: the documents of earlier batches, which come before those of docs whatever their doc_id. No other document may join a batch later.
        """
        self._settle()
        with scratch(self.spark) as folders:
            stage = lambda df, name: staged(df, name, folders)
            rows = tied(docs, few=True)
            own, again = once(rows, stage)
            level = self.levels.store(fingerprints(own, self.spec))
            marks = stage(scanned_rows(self.levels.beside(self.levels.table(level[1]))), "marks")
            others = None if history is None else (tied(history), marks.where("NOT is_new"), ["doc_id"])
            out = without_repeats(rows, own, again, marks.where("is_new"), others, self.spec, text, stage)
            out = staged(out if text else out.drop("kept"), "batch")
        self.levels.commit([*self.levels.live, level])
        return out


def by_doc_id(docs: DataFrame, shares: tuple[float, ...]) -> list[DataFrame]:
    """docs in ranges of doc_id that hold about these shares of the rows; null ids come last."""
    own = keyed(docs)
    inner = np.cumsum(shares)[:-1].tolist()
    cuts = own.agg(F.percentile_approx("doc_id", inner, 1000)).first()[0] or [] if inner else []
    edges = [None, *sorted(set(cuts)), None]
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    some = lambda low, high: docs.where((F.lit(True) if low is None else doc_id > low) & (F.lit(True) if high is None else doc_id <= high))
    return [some(low, high) for low, high in zip(edges, edges[1:], strict=False)]


def remove_repeated_bytes(docs: DataFrame, spec: Repeats = BYTES, text: bool = False, shares: tuple[float, ...] = (0.6, 0.4)) -> DataFrame:
    """All docs, as batches in the order of doc_id over levels of their own, which go at the end."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    levels, out, history = SuffixLevels(spark, path, spec), None, None
    try:
        for part in by_doc_id(docs, shares):
            got = levels.add(part, history, text)
            out = got if out is None else out.unionByName(got)
            history = part if history is None else history.unionByName(part)
    finally:
        levels.levels.drop()
    return out


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


#: Every window of every text, as hexadecimal digits, which is for small tables.
SQL_OP3 = """WITH
d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT rid, doc_id, i, md5_number(x[2 * i + 1:2 * i + 100]) AS g FROM (SELECT rid, doc_id, x, unnest(range(0, greatest(length(x) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first_id FROM w GROUP BY g),
h AS (SELECT rid, i FROM w JOIN f USING (g) WHERE first_id < doc_id),
o AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50, true) AS opens FROM h),
b AS (SELECT rid, i, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS span FROM o),
s AS (SELECT rid, min(i) AS a, max(i) + 50 AS z FROM b GROUP BY rid, span),
k AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS z FROM s UNION ALL SELECT rid, max(z), 1000000000 FROM s GROUP BY rid),
t AS (SELECT rid, string_agg(x[2 * a + 1:2 * z], '' ORDER BY a) AS kept FROM k JOIN d USING (rid) GROUP BY rid),
r AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY rid)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN r USING (rid) LEFT JOIN t USING (rid)"""

QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
SQL = {"op3_suffix_dedup": SQL_OP3}
