"""Benchmark decontamination: which words of which documents belong to a benchmark's n-grams.

The benchmark is a stated query set. It is cut into blocks of a bounded number of bytes; each block's windows (10 consecutive item words, or a whole
shorter item) are broadcast as a hash set, all documents' windows are looked up in it, and hits are verified against the item's words. With one block,
documents are scanned once and nothing is shuffled. With several, each block is a scan, and only hits are shuffled, by a key of the row (`cleaned` then shuffles the documents, too).

Null text: no words. An item without words has no window; an item whose item_id is null has windows, but can't be listed. Items of one id count once.
Repeated rows each get their row. Empty tables give empty or clean results. Other columns are ignored; `cleaned` keeps those of the documents.
"""

from __future__ import annotations


from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, staged, table, utf8
from .text import ALNUM, LOWER, Runs, covered, intervals, starts_of_windows, word_hashes, words

#: Words in a window, and bytes of benchmark text that are broadcast at once (their windows take about 20 times that).
WINDOW, BLOCK_BYTES = 10, 2_000_000
#: A rewriting that is never wrong about membership, only slow if full: bits of the first look-up table.
FILTER_BITS = 20


@dataclass
class Block:
    """Windows of some items: by their number of words, the sorted hashes and, by hash, each content with its items."""

    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    contents: dict[int, dict[int, list[tuple[bytes, list[str]]]]] = field(default_factory=dict)


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(column)
    return LOWER[data[off[0] : off[-1]]], off - off[0]


def _windows(data: np.ndarray, off: np.ndarray):
    start, end, at = words(data, off, ALNUM)
    return start, end, at, Runs(word_hashes(data, start, end))


def build_block(items: list[tuple[str | None, str | None]], window: int) -> Block:
    data, off = _lowered(pa.array([t for _, t in items], pa.string()))
    start, end, at, runs = _windows(data, off)
    found: dict[int, dict[int, dict[bytes, set]]] = {}
    for (name, _), a, z in zip(items, at[:-1].tolist(), at[1:].tolist(), strict=True):
        k = min(window, z - a)
        if k:
            firsts = np.arange(a, z - k + 1)
            own = [bytes(data[s:e]) for s, e in zip(start[a:z], end[a:z], strict=True)]
            for i, h in enumerate(runs.of(firsts, firsts + k).tolist()):
                names = found.setdefault(k, {}).setdefault(h, {}).setdefault(b" ".join(own[i : i + k]), set())
                if name is not None:
                    names.add(name)
    block = Block()
    for k, by in found.items():
        block.hashes[k] = np.array(sorted(by), np.uint64)
        block.filters[k] = np.zeros(1 << FILTER_BITS, bool)
        block.filters[k][block.hashes[k] & np.uint64((1 << FILTER_BITS) - 1)] = True
        block.contents[k] = {h: [(c, sorted(names)) for c, names in d.items()] for h, d in by.items()}
    return block


def hits_of(block: Block, data: np.ndarray, off: np.ndarray):
    """Word bounds of the rows' texts, n + 1 offsets of each row's words, hit words, and item ids by row."""
    start, end, at, runs = _windows(data, off)
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(at))
    first, last, items = [], [], {}
    for k, hashes in block.hashes.items():
        s = starts_of_windows(at, k)
        if not len(s):
            continue
        h = runs.each(k)[s]
        near = np.flatnonzero(block.filters[k][h & np.uint64((1 << FILTER_BITS) - 1)])
        near = near[hashes[np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)] == h[near]]
        for w, hash_ in zip(s[near].tolist(), h[near].tolist(), strict=True):
            content = b" ".join([bytes(data[a:b]) for a, b in zip(start[w : w + k], end[w : w + k], strict=True)])
            for c, names in block.contents[k][hash_]:
                if c == content:  # verified
                    first.append(w)
                    last.append(w + k)
                    items.setdefault(int(row_of[w]), set()).update(names)
    return start, end, at, covered(len(start), np.array(first, np.int64), np.array(last, np.int64)), items


HITS = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(rows: DataFrame, key: str, kind: str, block: Block, hit_only: bool) -> DataFrame:
    """key, n_words, hit spans in words, and item ids of each row (or of those with hits)."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        for b in batches:
            data, off = utf8(b.column("text"))
            n, spans, items, kept = [], [], [], []
            for i, j in chunks(off):
                start, _, at, hit, found = hits_of(shared.value, LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i])
                for r in range(j - i):
                    if r in found or hit[at[r] : at[r + 1]].any() or not hit_only:
                        s, e = intervals(hit[at[r] : at[r + 1]])
                        kept.append(i + r)
                        n.append(int(at[r + 1] - at[r]))
                        spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                        items.append(sorted(found.get(r, ())))
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))],
                [key, "n_words", "spans", "items"],
            )

    return rows.select(key, "text").mapInArrow(lean(run), f"{key} {kind}, {HITS}")


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        some = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield n, build_block([(r.item_id, r.text) for r in some.toLocalIterator()], window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (hit words, as maximal half-open runs) and items (sorted ids) of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.xxhash64("doc_id", "text").alias("row_key")
    hits = None
    for n, block in _blocks(benchmark, window, block_bytes):
        if n == 1:
            return _scan(rows, "doc_id", "long", block, False)
        some = staged(_scan(rows.select(key, "text"), "row_key", "long", block, hits is not None), "hits")
        hits = some if hits is None else hits.unionByName(some)
    return rows.select("doc_id", key).join(_merged(hits), "row_key", "left").select("doc_id", "n_words", "spans", "items")


def _merged(hits: DataFrame) -> DataFrame:
    """One row for each row_key: overlapping spans of different blocks become one. Equal rows, which share a key, count once."""
    flat = hits.distinct().groupBy("row_key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr("""aggregate(spans, CAST(array() AS array<struct<start: bigint, end: bigint>>), (a, s) -> CASE
        WHEN size(a) > 0 AND s.start <= element_at(a, -1).end
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(s.end, element_at(a, -1).end))))
        ELSE concat(a, array(s)) END)""")
    return flat.withColumn("spans", merged)


def cleaned(docs: DataFrame, benchmark: DataFrame, most_hit: float = 0.2, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the hit spans; a document of which more than `most_hit` of the words are hit goes as a whole. All columns stay.

    A span is cut from its first word's first byte to its last word's end. Several blocks give what one would: their hits are all found in the uncut
    text and merged before anything is cut; then rows are shuffled once, to meet their hits.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hits = None
    for n, block in _blocks(benchmark, window, block_bytes):
        if n == 1:
            return _cut(docs, block, most_hit)
        rows = docs.select(key.alias("row_key"), F.col("text").cast("string").alias("text"))
        some = staged(_scan(rows, "row_key", "long", block, True), "hits")
        hits = some if hits is None else hits.unionByName(some)
    found = _merged(hits).select(F.col("row_key").alias("__row_key"), F.col("spans").alias("__spans"))
    return _cut(docs.withColumn("__row_key", key).join(found, "__row_key", "left").select(*[docs[c] for c in docs.columns], "__spans"), None, most_hit).drop("__spans")


def _found(column: pa.Array, data: np.ndarray, off: np.ndarray):
    """What hits_of gives, from the rows' spans."""
    start, end, at = words(data, off, ALNUM)
    spans = column.to_pylist()
    first = [at[r] + x["start"] for r, own in enumerate(spans) for x in own or ()]
    last = [at[r] + x["end"] for r, own in enumerate(spans) for x in own or ()]
    return start, end, at, covered(len(start), np.array(first, np.int64), np.array(last, np.int64)), None


def _cut(docs: DataFrame, block: Block | None, most_hit: float) -> DataFrame:
    """docs without the hits of the block or, without one, without the words of their column __spans."""
    shared, where = block and docs.sparkSession.sparkContext.broadcast(block), docs.columns.index("text")

    def run(batches):
        for b in batches:
            column = b.column(where)
            data, off = utf8(column)
            changed, dropped = {}, []
            for i, j in chunks(off):
                base = off[i]
                lowered, own_off = LOWER[data[base : off[j]]], off[i : j + 1] - base
                start, end, at, hit, _ = hits_of(shared.value, lowered, own_off) if shared else _found(b.column("__spans").slice(i, j - i), lowered, own_off)
                for r in np.unique(np.searchsorted(at, np.flatnonzero(hit), "right") - 1).tolist():
                    own = hit[at[r] : at[r + 1]]
                    if own.sum() > most_hit * len(own):
                        dropped.append(i + r)
                        continue
                    out, last = [], off[i + r]
                    for s, e in zip(*intervals(own), strict=True):
                        out.append(data[last : base + start[at[r] + s]].tobytes())
                        last = base + end[at[r] + e - 1]
                    out.append(data[last : off[i + r + 1]].tobytes())
                    changed[i + r] = b"".join(out).decode("utf-8", "replace")
            if changed:
                texts = column.to_pylist()
                for r, x in changed.items():
                    texts[r] = x
                columns = b.columns
                columns[where] = pa.array(texts, column.type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            if dropped:
                b = b.take(pa.array(sorted(set(range(len(b))) - set(dropped)), pa.int64()))
            yield b

    return docs.mapInArrow(lean(run), docs.schema)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


#: Windows of 10 words as strings; an item of 1 to 9 words is one window.
SQL_OP4 = """WITH
d AS (SELECT *, row_number() OVER () AS rid FROM documents),
dw AS (SELECT doc_id, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bk),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT rid, i, win.k AS k, item_id FROM (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dp) p JOIN win ON p.k = win.k AND p.g = win.g),
cov AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS x FROM hit) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)"""

QUERIES = {"op4_decontamination": op4_decontamination}
SQL = {"op4_decontamination": SQL_OP4}
