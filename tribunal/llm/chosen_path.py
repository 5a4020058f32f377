"""Near duplicates by a chosen-path similarity join over sets of word shingles.

Each different set (copies are one set from the start) has minwise tokens under COORDINATES hash functions. A tree branches a node's sets by the minwise
tokens of BRANCHES functions chosen by the node: two sets go on together where they agree, which they do with the probability of their similarity. So a pair
at the threshold s stays together in a tree, however deep, with probability q, where q = 1 - (1 - s q)**2; independent trees are repeated until all of them
miss it with less than `miss`. The first step splits nearly all sets off; only nodes that are still large branch again, all nodes of a level at once.

In each node, sets are first tried against one leader, and what links is united, so that a large group of near copies costs a link each, not one for each
two. What then is in a node of one component needs no look. Nodes with few sets beside their largest component are compared exhaustively; so is a node whose
sets are so much alike that branching it would not save half of the comparisons. Comparisons are in tiles of bounded lists: by size and by sketches (a byte of
each minwise token), which must agree in `agreeing` places or more; what does is confirmed there on the full sets. A tile gives the links that unite
something in it, not all pairs that are alike, so what is written grows with the sets and not with the squares of groups.

A document without words (null or empty text) has an empty set and is linked with nothing. Repeated rows each get their row. A null doc_id counts as larger
than any. Sets are told apart by 128 bits. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, cleaning, decompressed, keyed, real_id, scratch, shared_dir, staged, table, utf8
from .components import components
from .jaccard import Shingles, _verified, sql_of
from .text import mix

#: Minwise tokens of a set, children of a node that each of its sets goes to, sets of a small node and of a list in a tile, and leaders a set tries.
COORDINATES, BRANCHES, SMALL, LEADERS = 128, 2, 256, 2
#: Pairs that a task compares at a time.
COMPARED = 1 << 18
_FACTORS = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def trees(percent: int, miss: float) -> int:
    """How many trees all miss a pair at the threshold with less than this probability, however deep they are."""
    s = percent / 100
    if not s > 0.5:
        raise ValueError("two branches a node only keep pairs of a similarity over 0.5 together")
    return max(1, ceil(log(miss) / log(1 - (2 * s - 1) / s**2)))


def agreeing(percent: int, miss: float) -> int:
    """In how many places the sketches of a pair at the threshold agree at least, but for this probability."""
    s, k, tail = percent / 100, 0, 0.0
    while (tail := tail + comb(COORDINATES, k) * s**k * (1 - s) ** (COORDINATES - k)) < miss:
        k += 1
    return k


def _surveyed(docs: DataFrame, spec: Shingles) -> DataFrame:
    """doc_id, size, k1 and k2 (the set's key), least (minwise tokens) and z (the compressed text) of each row."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data, off = utf8(b.column("text"))
            raw = memoryview(data)
            for i, j in chunks(off):
                row, h = spec.sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                at = np.searchsorted(row, np.arange(j - i + 1))
                size = np.diff(at)
                keys = []
                for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))))
                    keys.append(pa.array(mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)).view(np.int64)))
                least = np.zeros((j - i, COORDINATES), np.int32)
                if some := np.flatnonzero(size).tolist():
                    spread = mix(h)
                    for c, f in enumerate(_FACTORS):
                        least[some, c] = np.minimum.reduceat((spread * f) >> np.uint64(32), at[some]).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * COORDINATES, pa.int32()), pa.array(least.ravel()))
                texts = pa.array([z.compress(raw[s:e]) for s, e in zip(off[i:j], off[i + 1 : j + 1], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(size), *keys, lists, texts], ["doc_id", "size", "k1", "k2", "least", "z"])

    return docs.mapInArrow(run, "doc_id long, size long, k1 long, k2 long, least array<int>, z binary")


def _live(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows (node, sid) in nodes of several components, with root, n (sets of the node), main (its largest component), beside (sets not in that), the leader's
    sid and root."""
    named = rows.select("node", "sid")
    if roots is None:
        named = named.withColumn("root", F.col("sid"))
    else:
        named = named.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    own = named.groupBy("node", "root").agg(F.count(F.lit(1)).alias("own"), F.min(F.struct(F.xxhash64("sid"), "sid")).alias("first"))
    of = own.groupBy("node").agg(F.sum("own").alias("n"), F.count(F.lit(1)).alias("parts"), F.min(F.struct("first", "root")).alias("lead"), F.max(F.struct("own", "root")).alias("main"))
    of = of.where("parts > 1").select("node", "n", F.col("main.root").alias("main"), (F.col("n") - F.col("main.own")).alias("beside"), F.col("lead.first.sid").alias("lead"), F.col("lead.root").alias("lead_root"))
    return named.join(of, "node")


def _agreements(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places rows of x and y agree."""
    return (x == y).sum(1, dtype=np.uint8 if COORDINATES < 256 else np.int64).astype(np.int64)


def _sketches(column: pa.Array) -> np.ndarray:
    data, off = utf8(column)
    return data[off[0] : off[-1]].reshape(-1, COORDINATES)


def _led(live: DataFrame, sets: DataFrame, spec: Shingles, cut: int) -> DataFrame:
    """(a, b): each set with the leaders of its nodes that it agrees with best."""

    def run(batches):
        for b in batches:
            n = _agreements(_sketches(b.column("sketch")), _sketches(b.column("lead_sketch")))
            keep = pa.array(np.flatnonzero(n >= cut))
            yield pa.RecordBatch.from_arrays([b.column("sid").take(keep), b.column("lead").take(keep), pa.array(n).take(keep)], ["sid", "lead", "agree"])

    pairs = live.where("root <> lead_root").select("sid", "lead").distinct()
    both = pairs.join(sets.select("sid", "size", "sketch"), "sid").join(sets.select(F.col("sid").alias("lead"), F.col("size").alias("lead_size"), F.col("sketch").alias("lead_sketch")), "lead")
    both = both.where(100 * F.least("size", "lead_size") >= spec.percent * F.greatest("size", "lead_size"))
    best = Window.partitionBy("sid").orderBy(F.desc("agree"), "lead")
    led = both.select("sid", "lead", "sketch", "lead_sketch").mapInArrow(run, "sid long, lead long, agree long").withColumn("nth", F.row_number().over(best))
    return led.where(F.col("nth") <= LEADERS).select(F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")).distinct()


class _Lists:
    """Lists of sets from an Arrow column: n + 1 offsets, and the fields of all their sets."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        flat = column.flatten()
        self.off = np.concatenate(([0], np.cumsum(np.array(column.value_lengths()))))
        self.sid, self.size, self.root = (flat.field(k).to_numpy() for k in range(3))
        self.sketch, self.z = _sketches(flat.field(3)), flat.field(4) if flat.type.num_fields > 4 else None


def _alike(x: _Lists, y: _Lists, i: np.ndarray, j: np.ndarray, spec: Shingles, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i of x, j of y) across components that may be alike enough by size and sketch."""
    ok = (x.root[i] != y.root[j]) & (100 * np.minimum(x.size[i], y.size[j]) >= spec.percent * np.maximum(x.size[i], y.size[j]))
    i, j = i[ok], j[ok]
    near = _agreements(x.sketch[i], y.sketch[j]) >= cut
    return i[near], j[near]


def _ranges(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges of `many` from first on, one after another, and which range each is of."""
    of = np.repeat(np.arange(len(many)), many)
    return np.arange(len(of)) + (first - np.concatenate(([0], np.cumsum(many)[:-1])))[of], of


def _some(many: np.ndarray):
    """Runs of rows that have about COMPARED pairs each."""
    at = np.cumsum(many)
    cuts = np.unique(np.concatenate(([0], np.searchsorted(at, np.arange(0, int(at[-1]) if len(at) else 0, COMPARED), "right"), [len(many)])))
    return zip(cuts, cuts[1:], strict=False)


def _confirmed(x: _Lists, y: _Lists, i: np.ndarray, j: np.ndarray, spec: Shingles) -> list[tuple[int, int]]:
    """Links among the pairs (i of x, j of y) of a tile, by the full sets, that unite components not yet united in it."""

    def sets(lists, rows):
        texts = decompressed(lists.z.take(pa.array(rows)))
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        row, h = [], []
        for s, e in chunks(off):
            r, g = spec.sets(np.frombuffer(b"".join(texts[s:e]), np.uint8), off[s : e + 1] - off[s])
            row.append(r + s)
            h.append(g)
        return np.concatenate(h), np.searchsorted(np.concatenate(row), np.arange(len(texts) + 1))

    left, right = np.unique(i), np.unique(j)
    (hx, ax), (hy, ay) = sets(x, left), sets(y, right)
    known, code = np.unique(np.concatenate((hx, hy)), return_inverse=True)
    cx, cy, mark = code[: len(hx)], code[len(hx) :], np.zeros(len(known), np.int32)
    up: dict[int, int] = {}

    def top(r):
        while up.get(r, r) != r:
            r = up[r]
        return r

    out = []
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    at = np.searchsorted(i, left)
    for k, s, e in zip(range(len(left)), at, [*at[1:], len(i)], strict=True):
        own = cx[ax[k] : ax[k + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[cy], ay[:-1])
        mark[own] = 0
        other = np.searchsorted(right, j[s:e])
        share = both[other]
        for m in np.flatnonzero(100 * share >= spec.percent * (len(own) + (ay[1:] - ay[:-1])[other] - share)).tolist():
            a, b = top(int(x.root[left[k]])), top(int(y.root[j[s + m]]))
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((int(x.sid[left[k]]), int(y.sid[j[s + m]])))
    return out


def _within(x: _Lists, spec: Shingles, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that may be alike within the lists of x; i rises."""
    row, pairs = np.arange(x.off[-1]), [(np.zeros(0, np.int64),) * 2]
    later = np.repeat(x.off[1:], np.diff(x.off)) - row - 1
    for s, e in _some(later):
        j, of = _ranges(row[s:e] + 1, later[s:e])
        pairs.append(_alike(x, x, row[s:e][of], j, spec, cut))
    return tuple(np.concatenate(c) for c in zip(*pairs, strict=True))


def _between(x: _Lists, y: _Lists, spec: Shingles, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of x with y."""
    row, pairs = np.arange(x.off[-1]), [(np.zeros(0, np.int64),) * 2]
    many = np.full(len(row), y.off[-1])
    for s, e in _some(many):
        j, of = _ranges(np.zeros(e - s, np.int64), many[s:e])
        pairs.append(_alike(x, y, row[s:e][of], j, spec, cut))
    return tuple(np.concatenate(c) for c in zip(*pairs, strict=True))


def _compared(live: DataFrame, sets: DataFrame, texts, spec: Shingles, cut: int, stage) -> DataFrame:
    """(a, b): links across components in a node, enough of them to unite what any pair in it would.

    Sketches say which sets of a tile may have a partner there; only these get their texts (texts(sids): (sk, z)), and are confirmed tile by tile.
    """
    names = ["node", "tx", "ty", "first", "sid", "root"]

    def rows(node, tx, ty, parts):
        """parts: (first, lists, numbers of rows)."""
        some = [(np.full(len(n), f), x.sid[n], x.root[n]) for f, x, n in parts]
        first, sid, root = (np.concatenate(c) for c in zip(*some, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(v, len(sid))) for v in (node, tx, ty, first, sid, root)], names)

    def within(batches):
        for b in batches:
            x = _Lists(b.column("sets"))
            some = np.unique(np.concatenate(_within(x, spec, cut)))
            of = np.searchsorted(x.off, some, "right") - 1
            yield rows(b.column("node").to_numpy()[of], b.column("tile").to_numpy()[of], b.column("tile").to_numpy()[of], [(True, x, some)])

    def between(batches):
        for b in batches:
            for k in range(len(b)):
                x, y = _Lists(b.column("x").slice(k, 1)), _Lists(b.column("y").slice(k, 1))
                i, j = _between(x, y, spec, cut)
                if len(i):
                    yield rows(*(b.column(c)[k].as_py() for c in names[:3]), [(True, x, np.unique(i)), (False, y, np.unique(j))])

    def confirmed(batches):
        for b in batches:
            out = []
            for k in range(len(b)):
                x, y = _Lists(b.column("x").slice(k, 1)), _Lists(b.column("y").slice(k, 1))
                same = not len(y.sid)
                i, j = _within(x, spec, cut) if same else _between(x, y, spec, cut)
                out += _confirmed(x, x if same else y, i, j, spec) if len(i) else []
            a, c = (np.array(v, np.int64) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    # tiles of the largest component have numbers below zero: they aren't compared with each other
    spread = lambda n: F.pmod(F.xxhash64("sid", F.lit(1)), F.ceil(n / SMALL))
    tile = F.when(F.col("n") <= SMALL, 0).when(F.col("root") == F.col("main"), -1 - spread(F.col("n") - F.col("beside"))).otherwise(spread(F.col("beside"))).cast("long")
    full = sets.select("sid", "size", "sketch")
    lists = live.join(full, "sid").groupBy("node", tile.alias("tile")).agg(F.collect_list(F.struct("sid", "size", "root", "sketch")).alias("sets"), F.max("n").alias("n"))
    schema = "node long, tx long, ty long, first boolean, sid long, root long"
    found = lists.where("tile >= 0").select("node", "tile", "sets").mapInArrow(within, schema)
    large = lists.where(F.col("n") > SMALL)
    x, y = (large.select("node", F.col("tile").alias(f"t{s}"), F.col("sets").alias(s)) for s in "xy")
    tiles = x.where("tx >= 0").join(y, (x.node == y.node) & ((F.col("ty") < 0) | (F.col("tx") < F.col("ty"))))
    found = stage(found.unionByName(tiles.select(x.node, "tx", "ty", "x", "y").mapInArrow(between, schema)), "near")
    whole = found.join(full, "sid").join(texts(found.select("sid")).select(F.col("sk").alias("sid"), "z"), "sid")
    one = F.struct("sid", "size", "root", "sketch", "z")
    return whole.groupBy("node", "tx", "ty").agg(F.collect_list(F.when(F.col("first"), one)).alias("x"), F.collect_list(F.when(~F.col("first"), one)).alias("y")).select("x", "y").mapInArrow(confirmed, "a long, b long")


def _chosen(node: F.Column, which: int):
    """The number of the minwise token that a node's branch goes by."""
    one = F.pmod(F.xxhash64(node, F.lit(0)), F.lit(COORDINATES))
    return (one if which == 0 else F.pmod(one + 1 + F.pmod(F.xxhash64(node, F.lit(which)), F.lit(COORDINATES - 1)), F.lit(COORDINATES))).cast("int")


def _children(live: DataFrame, sets: DataFrame) -> DataFrame:
    """(above, n, node, sid): the children of all sets in the nodes of live."""
    kids = [F.xxhash64("node", F.lit(k), F.get("least", _chosen(F.col("node"), k))) for k in range(BRANCHES)]
    return live.join(sets.select("sid", "least"), "sid").select(F.col("node").alias("above"), "n", "sid", F.explode(F.array(*kids)).alias("node"))


def _roots(sets: DataFrame, texts, spec: Shingles, miss: float, stage) -> DataFrame | None:
    """(node, root): the sets that links reach and the smallest of them, by sid; None if there are no links. texts(sids): (sk, z) of these sets."""
    cut = agreeing(spec.percent, miss)
    tree = [F.xxhash64(F.lit(t), F.lit(b), F.get("least", F.lit(t * BRANCHES + b))) for t in range(trees(spec.percent, miss)) for b in range(BRANCHES)]
    rows, edges, roots = stage(sets.select("sid", F.explode(F.array(*tree)).alias("node")), "level"), None, None
    while True:
        live = stage(_live(rows, roots), "live")
        if live.isEmpty():
            return roots
        pairs = stage(_led(live, sets, spec, cut), "pairs")
        near = texts(pairs.select(F.explode(F.array("a", "b")).alias("sid")))
        edges, roots = _united(edges, stage(_verified(pairs, near, spec), "links"), roots, stage)
        live = stage(_live(live, roots), "live")
        here, rows, large = live, None, F.col("beside") > SMALL
        if not live.where(large).isEmpty():
            kids = stage(_children(live.where(large), sets), "kids")
            cost = kids.groupBy("above", "n", "node").count().groupBy("above", "n").agg(F.sum(F.col("count") * F.col("count")).alias("cost"))
            pays = stage(cost.where(2 * F.col("cost") <= F.col("n") * F.col("n")).select("above"), "pays")
            rows = kids.join(pays, "above", "left_semi").select("node", "sid")
            here = live.join(pays.withColumnRenamed("above", "node"), "node", "left_anti")
        links = stage(_compared(here, sets, texts, spec, cut, stage), "links")
        edges, roots = _united(edges, links, roots, stage)
        if rows is None or rows.isEmpty():
            return roots


def _united(edges: DataFrame | None, links: DataFrame, roots: DataFrame | None, stage) -> tuple[DataFrame | None, DataFrame | None]:
    """All edges so far with the new links, and the roots of what they join."""
    if links.isEmpty():
        return edges, roots
    edges = links if edges is None else edges.unionByName(links)
    return edges, components(edges, stage)


def _tabled(df: DataFrame, folders: list[str]) -> tuple[DataFrame, str]:
    """df as a table in buckets by the sets' keys, so that joins by these don't move its texts again; and its name."""
    spark, name = df.sparkSession, f"sets_{uuid.uuid4().hex}"
    folders.append(f"{shared_dir(spark)}/{name}")
    with cleaning(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEY).option("path", folders[-1]).format("parquet").saveAsTable(name)
    return spark.table(name), name


KEY = ["k1", "k2"]


def groups(docs: DataFrame, spec: Shingles = Shingles(), miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (whether it is the row's own) of each row of docs.

    miss: the probability that trees, or sketches, miss a link at the threshold; links above it are missed less often.
    """
    spark, name = docs.sparkSession, None
    with scratch(spark) as folders:
        stage = lambda df, name: staged(df, name, folders)
        rows = stage(_surveyed(keyed(docs), spec), "survey")
        one = rows.where("size > 0").groupBy(*KEY).agg(F.first("size").alias("size"), F.min("doc_id").alias("low"), F.first("least").alias("least"), F.first("z").alias("z"))
        bytes_ = F.unhex(F.array_join(F.transform("least", lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(255))), 2, "0")), ""))
        try:
            sets, name = _tabled(one.withColumns({"sid": F.monotonically_increasing_id(), "sketch": bytes_}), folders)

            def texts(sids):
                keys = stage(sets.select("sid", *KEY).join(sids.distinct(), "sid", "left_semi"), "keys")
                return stage(sets.select(*KEY, "z").join(keys, KEY).select(F.col("sid").alias("sk"), "z"), "texts")

            roots = _roots(sets, texts, spec, miss, stage)
            found = sets.select("sid", *KEY, "low")
            if roots is not None:
                found = found.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
                found = found.join(found.groupBy("root").agg(F.min("low").alias("least")), "root")
            else:
                found = found.withColumn("least", F.col("low"))
            out = rows.select("doc_id", "size", *KEY).join(stage(found.select(*KEY, "least"), "found"), KEY, "left")
            out = out.withColumn("least", F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")))
            out = out.select(real_id(), F.col("size").alias("n_shingles"), real_id("least").alias("component_id"))
            return staged(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near")
        finally:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")


CONTRACT = Shingles(5, 85)


def op13_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), CONTRACT)


SQL_OP13 = f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({sql_of(CONTRACT)})"

QUERIES = {"op13_minhash_near_dedup": op13_minhash_near_dedup}
SQL = {"op13_minhash_near_dedup": SQL_OP13}
