"""Whitening of embeddings by shifted Cholesky QR.

Entries become whole numbers, floor(64 c). Each different vector counts once in the fit; vectors move packed (one byte an entry where that is enough) and are
told apart by all their bytes. The centred rows A (each entry (n x - S) / n, with exact n x - S) are orthogonalised over and over: a pass over the rows adds
up the Gram matrix of Q, where Q is A after the triangular solves by all factors so far; its Cholesky factor is the next one. The first Gram matrix is
shifted so that it can't fail; later ones pivot, and what has no length of its own is left out (constant dimensions, sums of others). It ends when Q'Q is
the identity. The product R of the factors has A's singular values and right vectors: components of the covariance without squaring the condition of A.

Nothing but d x d numbers reaches the driver, whatever the rows: tasks send the rows of their Gram matrix to where these are added up, row by row.

Null vectors, vectors with null or non-finite entries, and empty ones are dropped. Vectors of another length are a space of their own: they are fitted among
themselves. Only components of positive variance are returned, so there are none where all vectors are equal (or there is just one). Repeated rows, shared
and null ids are rows of their own. Entries beyond 2**56 count as that. A deviation beyond a long is null. Other columns are ignored. An empty table gives
an empty result. Of equal eigenvalues, the components are some orthonormal basis; the largest entry of each component is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, staged, table, utf8

#: Steps of an entry, the number of components, rows of a block of 64 dimensions, passes at most, and how far from the identity Q'Q may be.
STEPS, COMPONENTS, BLOCK, PASSES, CLOSE = 64, 16, 4096, 12, 1e-12
#: Added to each entry in the sums and vectors that the contract speaks of. It leaves out of all that is centred.
LIFT = 1_000_000
FAR = float(1 << 62)


def _vectors(column: pa.Array):
    """(dimension, row numbers, entries as whole numbers) of the usable vectors of a batch, by dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    size = np.array(column.value_lengths().fill_null(0))
    off = np.concatenate(([0], np.cumsum(size)))
    c = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(c))))
    usable = (size > 0) & (bad[off[1:]] == bad[off[:-1]])
    for d in np.unique(size[usable]).tolist():
        row = np.flatnonzero(usable & (size == d))
        for k in range(0, len(row), most := _block(d)):
            some = row[k : k + most]
            yield d, some, np.clip(np.floor(c[off[some][:, None] + np.arange(d)] * STEPS), -FAR, FAR).astype(np.int64)


def _block(d: int) -> int:
    return max(16, 64 * BLOCK // d)


def _packed(batches):
    """(d, x): each vector in the narrowest whole numbers that hold it."""
    for b in batches:
        for d, _, y in _vectors(b.column("embedding")):
            width = np.select([(y >= -(1 << k)).all(1) & (y < 1 << k).all(1) for k in (7, 15, 31)], [1, 2, 4], 8)
            for w in np.unique(width).tolist():
                some = np.ascontiguousarray(y[width == w].astype(f"<i{w}"))
                at = pa.py_buffer((np.arange(len(some) + 1) * d * w).astype(np.int32))
                x = pa.Array.from_buffers(pa.binary(), len(some), [None, at, pa.py_buffer(some)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), d, np.int32)), x], ["d", "x"])


def _unpacked(batches, d: int):
    """Blocks of vectors as whole numbers."""
    for b in batches:
        data, off = utf8(b.column("x"))
        width = np.diff(off) // d
        for w in np.unique(width).tolist():
            at = off[:-1][width == w]
            for k in range(0, len(at), most := _block(d)):
                some = np.ascontiguousarray(data[at[k : k + most][:, None] + np.arange(d * w)])
                yield some.view(f"<i{w}").astype(np.int64)


@dataclass(frozen=True)
class Fit:
    """n different vectors and their sums (without LIFT); W maps centred vectors to whitened ones; shares of the variance; how far from whitened they are."""

    n: int
    sums: list[int]
    w: np.ndarray | None = None
    explained: tuple[float, ...] = ()
    error: float = 0.0

    def scaled(self, y: np.ndarray) -> np.ndarray:
        """n y - S, exactly: as Python's numbers where 64 bits may not do."""
        s = np.array(self.sums, object)
        if self.n * (int(np.abs(y).max(initial=0)) + 1) + max(map(abs, self.sums), default=0) < 1 << 62:
            return y * self.n - s.astype(np.int64)
        return y.astype(object) * self.n - s

    def centred(self, y: np.ndarray) -> np.ndarray:
        return self.scaled(y).astype(np.float64) / self.n


def _solved(q: np.ndarray, factors) -> np.ndarray:
    """The rows of q after a triangular solve by each factor (columns kept, upper triangle)."""
    for keep, r in factors:
        q = q[:, keep]
        for j in range(len(r)):
            q[:, j] = (q[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _added(batches):
    """The sums of the rows with the same number."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, raw in zip(b.column("i").to_pylist(), b.column("row").to_pylist(), strict=True):
            x = np.frombuffer(raw, "<f8")
            sums[i] = sums[i] + x if i in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["i", "row"])


def _gram(vectors: DataFrame, d: int, of, size: int) -> np.ndarray:
    """The sum of q'q over all blocks q = of(block) of `size` columns."""

    def run(batches):
        g = np.zeros((size, size))
        for y in _unpacked(batches, d):
            q = of(y)
            g += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([r.astype("<f8").tobytes() for r in g], pa.binary())], ["i", "row"])

    rows = vectors.mapInArrow(run, "i int, row binary").repartition("i").mapInArrow(_added, "i int, row binary").collect()  # `size` rows
    g = np.zeros((size, size))
    for r in rows:
        g[r.i] = np.frombuffer(r.row, "<f8")
    return (g + g.T) / 2


def pivoted_cholesky(g: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The columns that have a length over `least` (squared) of their own, and u with u'u = g, whose part at these columns is an upper triangle."""
    g, n, keep = g.copy(), len(g), []
    u = np.zeros((n, n))
    for k in range(n):
        j = int(np.argmax(np.where(np.isin(np.arange(n), keep), -np.inf, np.diag(g))))
        if not g[j, j] > least:
            return np.array(keep, int), u[:k]
        u[k] = g[j] / np.sqrt(g[j, j])
        u[k, keep] = 0
        g -= np.outer(u[k], u[k])
        keep.append(j)
    return np.array(keep, int), u


def _sums(vectors: DataFrame, d: int) -> list[int]:
    def run(batches):
        s = np.zeros(d, object)
        for y in _unpacked(batches, d):
            small = int(np.abs(y).max(initial=0)) * len(y) < 1 << 62
            s = s + (y if small else y.astype(object)).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([int(x) for x in s], pa.decimal128(38))], ["i", "s"])

    rows = vectors.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # d rows
    return [int(r.s) for r in sorted(rows, key=lambda r: r.i)]


def _fitted(vectors: DataFrame, d: int, n: int, components: int) -> Fit:
    """From the n different vectors of dimension d."""
    fit, factors, r, shift = Fit(n, _sums(vectors, d)), [], np.eye(d), 0.0
    for k in range(PASSES):
        size = len(r)
        g = _gram(vectors, d, lambda y: _solved(fit.centred(y), factors), size)  # noqa: B023
        if k and np.abs(g - np.eye(size)).max(initial=0) <= CLOSE:
            break
        if k == 0:
            if not np.trace(g) > 0:
                return fit
            shift = 11 * (_block(d) * d + d * (d + 1)) * 2.0**-53 * np.trace(g)
            g = g + shift * np.eye(size)
        keep, u = pivoted_cholesky(g, 0.0 if k == 0 else CLOSE)
        factors = [*factors, (keep, u[:, keep])]
        r = u @ r
    _, sigma, axes = np.linalg.svd(r)
    e = sigma**2 / n
    top = min(components, len(e))
    axes = axes[:top] * np.sign(axes[np.arange(top), np.abs(axes[:top]).argmax(1)])[:, None]
    w = axes.T / np.sqrt(e[:top])
    g = _gram(vectors, d, lambda y: np.column_stack((fit.centred(y) @ w, np.ones(len(y)))), top + 1)
    mean = g[:top, top] / n
    error = np.abs(g[:top, :top] / n - np.outer(mean, mean) - np.eye(top)).max(initial=0)
    return Fit(n, fit.sums, w, tuple((e[:top] / e.sum()).tolist()), float(error))


def fits(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each dimension among the vectors of rows (embedding)."""
    spark = rows.sparkSession
    with scratch(spark) as folders:
        vectors = staged(rows.select("embedding").mapInArrow(_packed, "d int, x binary").distinct(), "vectors", folders)
        sizes = vectors.groupBy("d").count().collect()  # a row for each dimension
        return {r.d: _fitted(vectors.where(F.col("d") == r.d), r.d, r["count"], components) for r in sizes}


def whitened(rows: DataFrame, by: dict[int, Fit]) -> DataFrame:
    """vec_id, d, deviation and whitened (an array with an entry for each component) of each usable row of rows (vec_id, embedding)."""

    def run(batches):
        for b in batches:
            for d, row, y in _vectors(b.column("embedding")):
                fit = by.get(d)
                if fit is None or fit.w is None:
                    continue
                x = fit.scaled(y)
                if x.dtype == object or d * (float(np.abs(x).max(initial=0)) + 1) ** 2 >= 2.0**62:
                    x = x.astype(object)
                dev = (x * x).sum(1)
                dev = pa.array([v if v < 1 << 63 else None for v in dev.tolist()], pa.int64())
                w = x.astype(np.float64) / fit.n @ fit.w
                at = pa.array(np.arange(len(y) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(row)), pa.array(np.full(len(y), d, np.int32)), dev, pa.ListArray.from_arrays(at, pa.array(w.ravel()))], ["vec_id", "d", "deviation", "whitened"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, d int, deviation long, whitened array<double>")


def components_of(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row and component."""
    by = fits(rows, components)
    fact = lambda value: F.coalesce(*[F.when(F.col("d") == d, value(f)) for d, f in by.items() if f.w is not None], F.lit(None))
    out = whitened(rows, by).select("vec_id", "d", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), fact(lambda f: F.lit(f.n)).cast("long").alias("n"), "deviation", "whitened",
        F.get(fact(lambda f: F.array(*map(F.lit, f.explained))).cast("array<double>"), F.col("at")).alias("explained"),
        fact(lambda f: F.lit(f.error)).cast("double").alias("identity_error"),
    )


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
#: Eigenvectors are beyond SQL; a test compares with dense linear algebra.
SQL: dict[str, str] = {}
