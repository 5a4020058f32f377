"""Packing: documents become sequences of at most `size` tokens, in input order.

Each task tokenises its documents and cuts its own token stream by dynamic programming over cut points (document ends, sentence ends, and a grid
inside longer stretches without either): cost = padding + a penalty by the kind of cut + a fixed cost per sequence. A sequence is padded to `size`,
so its padding is size - length, but none if the length is a power of two. As that is linear in the start, the best start within reach is the head of
a monotone queue over cost + position; starts at power-of-two distances are looked up besides. No shuffle: sequences never span tasks, the last
unfinished window is carried from block to block within a task, so memory doesn't grow with the partition.

Null text: empty, so the document is its end token alone. Empty tables give no rows; repeated rows are packed as often as they come; columns other
than doc_id and text are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import gc
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, table, utf8
from .tokens import piece_cache, split_words, tokenizer_path, word_parts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Costs in tokens: a cut at a sentence end, a cut elsewhere inside a document, and each sequence.
SENTENCE_CUT, BARE_CUT, SEQUENCE = 8, 64, 48
#: Stretches without a cut point longer than this get one each GRID tokens; tokens per block of the dynamic program.
GRID, BLOCK = 128, 1 << 20


def cut_windows(at: np.ndarray, penalty: np.ndarray, size: int, last: bool) -> list[int]:
    """Numbers of the chosen cut points, from 0 on. at: positions of the cut points, the first 0, gaps at most `size`.

    Without `last`, the stretch after the last chosen cut is left over for the next block.
    """
    n = len(at)
    number = np.full(int(at[-1]) + 1, -1, np.int64)
    number[at] = np.arange(n)
    to, come = [], []
    d = 1
    while d < size:
        j = np.searchsorted(at, d) + np.arange(n - np.searchsorted(at, d))
        i = number[at[j] - d]
        to.append(j[i >= 0])
        come.append(i[i >= 0])
        d *= 2
    to, come = np.concatenate([*to, [n]]), np.concatenate([*come, [0]])
    order = np.argsort(to, kind="stable")
    first = np.searchsorted(to[order], np.arange(n + 1)).tolist()
    come = come[order].tolist()
    pos, pen = at.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque = deque()
    for j in range(1, n):
        i, p = j - 1, pos[j]
        key = cost[i] + pos[i]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i, pos[i]))
        while p - queue[0][2] > size:
            queue.popleft()
        best, b = queue[0][0] + size - p, queue[0][1]
        for t in range(first[j], first[j + 1]):
            i = come[t]
            if cost[i] < best:
                best, b = cost[i], i
        cost[j] = best + pen[j] + SEQUENCE
        back[j] = b
    j = n - 1
    if not last:  # the cheapest cut within reach of the end
        near = int(np.searchsorted(at, at[-1] - size, "right"))
        j = min(range(max(near, 0), n), key=lambda j: (cost[j] + 0.05 * (pos[-1] - pos[j]), -j))
    path = [j]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


class _Stream:
    """A task's token stream: documents are added, sequences of pieces come out."""

    def __init__(self, size: int, ends: np.ndarray, first_id: int):
        self.size, self.ends, self.next_id = size, ends, first_id
        self.ids = np.zeros(0, np.uint32)
        self.doc, self.tokens, self.base, self.len = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, doc: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        self.ids = np.concatenate((self.ids, ids))
        self.doc, self.tokens = np.concatenate((self.doc, doc)), np.concatenate((self.tokens, lens))
        self.base, self.len = np.concatenate((self.base, np.zeros(len(doc), np.int64))), np.concatenate((self.len, lens))

    def take(self, last: bool) -> list[np.ndarray]:
        n = len(self.ids)
        ends = np.cumsum(self.len)
        penalty = np.full(n + 1, -1, np.int32)
        penalty[np.flatnonzero(self.ends[self.ids]) + 1] = SENTENCE_CUT
        penalty[0] = 0
        penalty[ends] = 0
        known = np.flatnonzero(penalty >= 0)
        gap = np.diff(known)
        grid = max(1, min(GRID, self.size // 2))
        long = gap > 2 * grid
        if long.any():
            more = np.concatenate([np.arange(s + grid, s + g, grid) for s, g in zip(known[:-1][long], gap[long], strict=True)])
            penalty[more] = BARE_CUT
            known = np.flatnonzero(penalty >= 0)
        path = cut_windows(known, penalty[known], self.size, last)
        cut = known[path]
        whole = np.concatenate(([0], ends))
        at = np.union1d(cut, whole[whole <= cut[-1]])
        s, e = at[:-1], at[1:]
        d = np.searchsorted(ends, s, "right")
        w = np.searchsorted(cut, s, "right") - 1
        raw = memoryview(self.ids.astype("<u4").tobytes())
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)), np.int64, len(s))
        doc_start = whole[:-1][d]
        out = [self.doc[d], self.base[d] + s - doc_start, e - s, crc, self.tokens[d], self.next_id + w, s - cut[w]]
        self.next_id += len(cut) - 1
        k, c = int(np.searchsorted(ends, cut[-1], "right")), int(cut[-1])
        used = np.maximum(c - whole[:-1][k:], 0)
        self.ids = self.ids[c:]
        self.doc, self.tokens, self.base, self.len = self.doc[k:], self.tokens[k:], self.base[k:] + used, self.len[k:] - used
        return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of a document. tokenizer: path of a `tokenizers` file whose tokens never hold white space."""

    def run(batches):
        gc.disable()  # the cache holds millions of small objects that never form cycles
        cache = piece_cache(tokenizer, split_words, word_parts)
        try:
            yield from pieces(batches, cache)
        finally:
            cache.rest()
            gc.enable()

    def pieces(batches, cache):
        vocab = cache.tokenizer.get_vocab()
        ends = np.zeros(max(vocab.values(), default=0) + 2, bool)
        for t, i in vocab.items():
            ends[i] = t.removesuffix("</w>")[-1:] in (".", "!", "?")
        stream = _Stream(size, ends, TaskContext.get().partitionId() << 40)
        low = np.iinfo(np.int64).min  # stands for null among ids

        def rows(out):
            doc = pa.array(out[0], mask=out[0] == low)
            return pa.RecordBatch.from_arrays([doc, *map(pa.array, out[1:])], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            data, off = utf8(b.column("text"))
            doc = b.column("doc_id").fill_null(low).to_numpy(zero_copy_only=False)
            for i, j in chunks(off):
                texts = [bytes(data[s:e]).decode("utf-8", "replace") for s, e in zip(off[i:j], off[i + 1 : j + 1], strict=True)]
                ids, at = cache.ids(texts)
                lens = np.diff(at) + 1
                full = np.insert(ids, at[1:], end_id).astype(np.uint32)
                stream.add(doc[i:j], full, lens)
                if len(stream.ids) >= BLOCK:
                    yield rows(stream.take(False))
        if len(stream.ids):
            yield rows(stream.take(True))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op2_packing": op2_packing}
SQL: dict[str, str] = {}
