"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to the documents' n-grams, summed per document.

Documents are first put into blocks (rows of a staged table that hold a few MB of compressed texts), so that a block's distinct n-grams can be asked for
and answered as sorted arrays. For each order, a block sends its distinct n-grams and their counts to the hash ranges; a range adds up what all blocks
sent, which is its part of the count table, and answers each block in its own order. A frequent n-gram is one entry per block, so no range is hot. Then
each block joins the answers and scores its documents.

Counts are those of all documents; with leave_out, less the document's own, so that a text isn't judged by itself. A word's score is c(context word) /
c(context) for the longest context, up to two words, that leaves a count; each shorter context costs a factor of `alpha`; at last it is
max(c(word), 1) / words. Scores are natural logarithms, each rounded to millionths and summed as integers.

Null text: no words, score 0. Repeated rows each get their row, and count twice. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, decompressed, staged, table, utf8
from .text import LOWER, SPACE, Runs, starts_of_windows, word_hashes, words

#: Bytes of text in a block, words per hash range, and blocks that a task scores.
BLOCK, RANGE, PER_TASK = 4 << 20, 2_000_000, 4


def _planes(x: np.ndarray, width: int) -> bytes:
    """Byte planes, which compress well where the high bytes are alike."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def _flat(raw: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _text(z: bytes) -> np.ndarray:
    return LOWER[np.frombuffer(decompressed(pa.array([z], pa.binary()))[0], np.uint8)]


class _Grams:
    """Words of a block's rows, and their n-grams by the place of the last word."""

    def __init__(self, data: np.ndarray, lens: np.ndarray):
        start, end, self.at = words(data, np.concatenate(([0], np.cumsum(lens))), ~SPACE)
        self.runs = Runs(word_hashes(data, start, end))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        s = starts_of_windows(self.at, k)
        return s + k - 1, self.runs.each(k)[s]


def _ranges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of equal ranges of hashes in a sorted array."""
    return np.searchsorted((sorted_hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1))


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches):
        import zstandard

        z, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        for b in batches:
            data, off = utf8(b.column("text"))
            ids = b.column("doc_id")
            for i, j in chunks(off, BLOCK):
                part, lens = data[off[i] : off[j]], np.diff(off[i : j + 1])
                n = int(words(part, off[i : j + 1] - off[i], ~SPACE)[2][-1])
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), pa.array([ids[i:j].to_pylist()], pa.list_(pa.int64())), pa.array([lens.tolist()], pa.list_(pa.int64())), pa.array([z.compress(part.tobytes())], pa.binary())], ["block", "n_words", "ids", "lens", "z"])
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "block long, n_words long, ids array<long>, lens array<long>, z binary")


def _asked(blocks: DataFrame, k: int, n: int) -> DataFrame:
    """(part, block, grams, counts): the distinct k-grams of each block by hash range."""

    def run(batches):
        for b in batches:
            for block, lens, z in zip(b.column("block").to_pylist(), b.column("lens"), b.column("z").to_pylist(), strict=True):
                hashes, counts = np.unique(_Grams(_text(z), lens.values.to_numpy()).of(k)[1], return_counts=True)
                at = _ranges(hashes, n)
                full = np.flatnonzero(np.diff(at)).tolist()
                grams = [_planes(np.diff(hashes[at[p] : at[p + 1]], prepend=np.uint64(0)), 8) for p in full]
                counts = [_planes(counts[at[p] : at[p + 1]], 4) for p in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([block] * len(full), pa.int64()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())], ["part", "block", "grams", "counts"])

    return blocks.select("block", "lens", "z").mapInArrow(run, "part long, block long, grams binary, counts binary")


def _answered(k: int):
    """For rows sorted by part: the total counts, to each block in the order it asked."""

    def answer(part, asked):
        import zstandard

        z = zstandard.ZstdDecompressor()
        grams = [np.cumsum(_flat(z.decompress(g), 8)) for _, g, _ in asked]
        counts = [_flat(z.decompress(c), 4).astype(np.int64) for _, _, c in asked]
        known, where = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts), len(known)).astype(np.int64)[where]
        out = [_planes(x, 8) for x in np.split(total, np.cumsum([len(g) for g in grams])[:-1])]
        n = len(asked)
        return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in asked], pa.int64()), pa.array([k] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(out, pa.binary())], ["block", "k", "part", "total"])

    def run(batches):
        now, asked = None, []
        for b in batches:
            for part, *row in zip(*[b.column(c).to_pylist() for c in ("part", "block", "grams", "counts")], strict=True):
                if part != now and asked:
                    yield answer(now, asked)
                    asked = []
                now = part
                asked.append(row)
        if asked:
            yield answer(now, asked)

    return run


def _own(grams: np.ndarray, row: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each occurrence's number in `known`, and how often its row has it."""
    number = np.searchsorted(known, grams)
    _, where, times = np.unique(row * np.int64(len(known) + 1) + number, return_inverse=True, return_counts=True)
    return number, times[where]


def _scorer(order: int, total_words: int, alpha: float, leave_out: bool):
    def run(batches):
        import zstandard

        for b in batches:
            for lens, ids, z, answers in zip(b.column("lens"), b.column("ids").to_pylist(), b.column("z").to_pylist(), b.column("answers").to_pylist(), strict=True):
                g = _Grams(_text(z), lens.values.to_numpy())
                n, per_row = int(g.at[-1]), np.diff(g.at)
                row = np.repeat(np.arange(len(per_row)), per_row)
                left = np.zeros((order + 1, n), np.int64)  # by order and last word: the count, without the row's own
                by: dict[int, list] = {}
                for a in sorted(answers or [], key=lambda a: (a["k"], a["part"])):
                    by.setdefault(a["k"], []).append(_flat(zstandard.ZstdDecompressor().decompress(a["total"]), 8))
                for k in by:
                    last, h = g.of(k)
                    number, own = _own(h, row[last], np.unique(h))
                    left[k, last] = np.concatenate(by[k])[number].view(np.int64) - (own if leave_out else 0)
                place = np.arange(n) - g.at[:-1][row]
                score, level = np.zeros(n), np.zeros(n, np.int64)
                every = np.maximum(total_words - (per_row[row] if leave_out else 0), 1)
                for k in range(order, 0, -1):
                    can = (level == 0) & (place >= k - 1)
                    use = can & (left[k] > 0) if k > 1 else can
                    context = left[k - 1, np.maximum(np.arange(n) - 1, 0)] if k > 1 else every
                    ratio = np.maximum(left[k][use], 1) / context[use]
                    backed = np.minimum(place[use], order - 1) - (k - 1)
                    score[use] = np.round((np.log(ratio) + backed * math.log(alpha)) * 1e6)
                    level[use] = k
                sums = [np.bincount(row, score, len(per_row)).round().astype(np.int64), *[np.bincount(row[level == k], minlength=len(per_row)) for k in range(1, order + 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(per_row), *map(pa.array, sums)], ["doc_id", "n_words", "score_micro", *[f"n_order_{k}" for k in range(1, order + 1)]])

    return run


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, leave_out: bool = True) -> DataFrame:
    """doc_id, n_words, score_micro (millionths of a natural logarithm), and n_order_k: words scored by k-grams, of each row of docs."""
    blocks = staged(_blocks(docs), "blocks")
    total, n_blocks = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count(F.lit(1))).first()
    parts, tasks, answers = -(-total // RANGE) or 1, -(-n_blocks // PER_TASK) or 1, None
    for k in range(1, order + 1):
        asked = _asked(blocks, k, parts).repartition(parts, "part").sortWithinPartitions("part")
        some = staged(asked.mapInArrow(_answered(k), "block long, k int, part long, total binary"), f"counts-{k}")
        answers = some if answers is None else answers.unionByName(some)
    # a task scores a few blocks, however many there are
    answers = answers.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("k", "part", "total")).alias("answers"))
    columns = ", ".join(["doc_id long, n_words long, score_micro long", *[f"n_order_{k} long" for k in range(1, order + 1)]])
    return blocks.drop("n_words").repartition(tasks, "block").join(answers, "block", "left").select("lens", "ids", "z", "answers").mapInArrow(_scorer(order, total, alpha, leave_out), columns)


def op1_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


SQL_OP1 = """WITH
d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, len(w) AS n, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3
    FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
t AS (SELECT count(*) AS words FROM p),
c AS (SELECT rid, n, i, count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY rid, g1) AS c1,
    CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY rid, g2) END AS c2,
    CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY rid, g3) END AS c3 FROM p),
x AS (SELECT *, lag(c1) OVER o AS b1, lag(c2) OVER o AS b2, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 ELSE 1 END AS level FROM c WINDOW o AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT rid, level, CAST(round((ln(CASE level WHEN 3 THEN c3 / CAST(b2 AS DOUBLE) WHEN 2 THEN c2 / CAST(b1 AS DOUBLE) ELSE greatest(c1, 1) / CAST(greatest(words - n, 1) AS DOUBLE) END)
    + (least(i - 1, 2) - (level - 1)) * ln(CAST(0.4 AS DOUBLE))) * 1e6) AS BIGINT) AS v FROM x, t),
a AS (SELECT rid, sum(v) AS v, count(*) FILTER (level = 1) AS n1, count(*) FILTER (level = 2) AS n2, count(*) FILTER (level = 3) AS n3 FROM s GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(v, 0) AS BIGINT) AS score_micro, CAST(coalesce(n1, 0) AS BIGINT) AS n_order_1,
    CAST(coalesce(n2, 0) AS BIGINT) AS n_order_2, CAST(coalesce(n3, 0) AS BIGINT) AS n_order_3 FROM d LEFT JOIN a USING (rid)"""

QUERIES = {"op1_lm_scores": op1_lm_scores}
SQL = {"op1_lm_scores": SQL_OP1}
