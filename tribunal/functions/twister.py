"""Draws of Python's generator (the Mersenne Twister) in parallel: tasks start anywhere in its sequence.

The words of the generator follow a linear recurrence over GF(2), so the words from place N on are sums of the first ones, with the coefficients of t**N
modulo the recurrence's polynomial. That polynomial is found once from the words themselves (Berlekamp and Massey), and t**N takes log N squarings. Draws
below m take as many words as it takes to get one below m, so blocks of words are counted first, and items are numbered from the sums before their block.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The generator's recurrence (words, distance, matrix, bits of the polynomial).
WORDS, APART, MATRIX, BITS = 624, 397, 0x9908B0DF, 19937
#: Words of a block.
BLOCK = 1 << 20


def _grown(words: np.ndarray, n: int) -> np.ndarray:
    """n words of the sequence that starts with these."""
    x = np.empty(max(n, WORDS), np.uint32)
    x[:WORDS] = words
    k = WORDS
    while k < n:
        m = min(WORDS - APART, n - k)
        y = (x[k - WORDS : k - WORDS + m] & np.uint32(0x80000000)) | (x[k - WORDS + 1 : k - WORDS + 1 + m] & np.uint32(0x7FFFFFFF))
        x[k : k + m] = x[k - WORDS + APART : k - WORDS + APART + m] ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), np.uint32(MATRIX), np.uint32(0))
        k += m
    return x[:n]


@functools.cache
def _polynomial() -> int:
    """The polynomial of the recurrence, its coefficients as bits: the shortest that explains one bit of the words."""
    bits = (_grown(np.array(random.Random(1).getstate()[1][:WORDS], np.uint32), 2 * BITS + 2)[2:] & 1).tolist()
    c, b, size, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = (seen << 1) | bit  # the latest bit is the lowest
        if (c & seen).bit_count() & 1:
            before = c
            c ^= b << gap
            if 2 * size <= n:
                size, b, gap = n + 1 - size, before, 1
                continue
        gap += 1
    return int(format(c, f"0{size + 1}b")[::-1], 2)


_SPREAD = np.array([sum((k >> j & 1) << (2 * j) for j in range(8)) for k in range(256)], "<u2")


def _power(n: int) -> int:
    """t**n modulo the polynomial."""
    p = _polynomial()
    top, r = p.bit_length() - 1, 1
    for bit in bin(n)[2:]:
        r = int.from_bytes(_SPREAD[np.frombuffer(r.to_bytes(top // 8 + 1, "little"), np.uint8)].tobytes(), "little") << (bit == "1")
        while (d := r.bit_length() - 1) >= top:
            r ^= p << (d - top)
    return r


def words_from(seed: int, start: int) -> np.ndarray:
    """The state before the word number `start` that random.Random(seed) draws."""
    x = np.array(random.Random(seed).getstate()[1][:WORDS], np.uint32)
    if start == 0:
        return x
    x, g, out = _grown(x, BITS + WORDS + 1), _power(start - 1), np.zeros(WORDS, np.uint32)  # the first word isn't in the recurrence with all its bits
    for i in np.flatnonzero(np.unpackbits(np.frombuffer(g.to_bytes(BITS // 8 + 1, "little"), np.uint8), bitorder="little")).tolist():
        out ^= x[1 + i : 1 + i + WORDS]
    return out


def draws(seed: int, start: int, n: int) -> np.ndarray:
    """The n words from number `start` on that random.Random(seed) draws."""
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": words_from(seed, start), "pos": WORDS}}
    return source.random_raw(n).astype(np.uint32)


def choices(spark: SparkSession, seed: int, m: int, n: int, block: int = BLOCK) -> DataFrame:
    """item_no and drawn (0 to m - 1) of the first n calls of random.Random(seed).randrange(m) or choice of m things, whatever the partitions."""
    if not 0 < m < 1 << 32:
        raise ValueError(f"draws are below 2**32, not {m}")
    bits = m.bit_length()

    def taken(number: int) -> np.ndarray:
        r = draws(seed, number * block, block) >> np.uint32(32 - bits)
        return r[r < m]

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(taken(k)) for k in b.column("id").to_pylist()], pa.int64())], ["block", "n"])

    def emit(batches):
        for b in batches:
            for k, before in zip(b.column("block").to_pylist(), b.column("before").to_pylist(), strict=True):
                r = taken(k)[: n - before]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(before, before + len(r))), pa.array(r.astype(np.int64))], ["item_no", "drawn"])

    each = m / (1 << bits)  # of a word
    blocks = max(1, int(n / each * 1.01) // block + 1)
    while True:
        rows = spark.range(0, blocks, 1, blocks).mapInArrow(count, "block long, n long")
        counts = spark.createDataFrame([tuple(r) for r in rows.collect()], "block long, n long")  # a row for a million words
        if counts.agg(F.sum("n")).first()[0] >= n:
            break
        blocks += blocks // 8 + 1
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before).where(F.col("before") < n).select("block", "before").repartition(blocks, "block").mapInArrow(emit, "item_no long, drawn long")
