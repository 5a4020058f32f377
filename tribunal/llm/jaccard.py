"""N-gram Jaccard join: adaptive multi-match prefixes over sets of word shingles.

Two sets of Jaccard similarity p or more share at least `need` shingles among the first |x| - ceil(p |x|) + need of each, in any fixed order of all
shingles. The order here is by estimated frequency (a count sketch of fixed size over all documents: a wrong estimate costs time, never a link), then by
hash. Each document chooses its own `need`: it lengthens its prefix, and asks for as many more shared shingles, if the estimated lists to read and
candidates to verify get fewer. A pair must then share the smaller of its two needs. Candidates are verified on their whole texts.

If sets x and y are similar enough, a shingle they share among the first ones of x (the first `_early` for sizes alike) is in y's prefix as well, since few
smaller ones of y are missing in x. So early shingles that no other prefix has are not shared, which bounds the overlap of a pair before it is verified.

Large groups of near copies would give a pair for each two of them. So candidates are first tried against a few partners only (of each list, a leader:
first the one with the fewest early shingles alone, then another; each document tries its two most promising leaders), and what links is united. After
that all pairs that share enough, and are not united yet, are verified, so no link between components is missed. In a list, pairs of its largest
component are not formed, nor pairs whose sets share the shingle just before, too. Documents of the same set are one node throughout.

A document without words (null or empty text) has an empty set and is linked with nothing. Repeated rows each get their row. A null doc_id counts as
larger than any. Sets are told apart by 64-bit keys. Other columns are ignored; `keep_one` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, decompressed, keyed, lean, real_id, scratch, staged, table, utf8
from .components import components
from .text import LOWER, SPACE, Runs, mix, starts_of_windows, word_hashes, words

#: log2 of the sketch's counters, and the parts it is summed in.
SLOTS, PARTS = 20, 64
#: Longest extension of a prefix, and the cost of a verification in list entries.
MOST_NEED, VERIFY = 12, 4.0
#: Rounds of trying leaders, before all pairs that are left.
ROUNDS = 2


@dataclass(frozen=True)
class Shingles:
    size: int = 5
    percent: int = 80

    def sets(self, data: np.ndarray, off: np.ndarray):
        """row and hash of each row's distinct shingles, by row, then hash."""
        data = LOWER[data]
        start, end, at = words(data, off, ~SPACE)
        runs = Runs(word_hashes(data, start, end))
        s = starts_of_windows(at, self.size)
        few = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < self.size))
        row = np.concatenate((np.searchsorted(at, s, "right") - 1, few))
        h = np.concatenate((runs.each(self.size)[s], runs.of(at[few], at[few + 1])))
        k = np.lexsort((h, row))
        row, h = row[k], h[k]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return row[first], h[first]


def _keys(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, sizes and keys of the rows' sets."""
    off = np.searchsorted(row, np.arange(n + 1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h))))
    size = np.diff(off)
    return off, size, mix(total[off[1:]] - total[off[:-1]] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _survey(docs: DataFrame, spec: Shingles) -> DataFrame:
    """(doc_id, tk, sk, size) of each row, and the tasks' counts of shingles by slot (part, counts). tk: a hash of the row's text."""

    def run(batches):
        import zstandard

        counts = np.zeros(1 << SLOTS, np.int64)
        for b in batches:
            data, off = utf8(b.column("text"))
            keys, sizes = [], []
            for i, j in chunks(off):
                row, h = spec.sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                _, size, sk = _keys(row, h, j - i)
                counts += np.bincount((h >> np.uint64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS)
                keys.append(sk)
                sizes.append(size)
            n, none = len(b), np.zeros(0, np.int64)
            sk, size = (np.concatenate([none, *x]) for x in (keys, sizes))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tk"), pa.array(sk), pa.array(size), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        z = zstandard.ZstdCompressor(level=3)
        blobs = [z.compress(x.astype("<i8").tobytes()) for x in np.split(counts, PARTS)]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(PARTS, pa.int64())] * 4, pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], names)

    names = ["doc_id", "tk", "sk", "size", "part", "counts"]
    return docs.withColumn("tk", F.xxhash64("text")).mapInArrow(lean(run), "doc_id long, tk long, sk long, size long, part int, counts binary")


def _sum_parts(batches):
    import zstandard

    z, sums = zstandard.ZstdCompressor(level=3), {}
    for b in batches:
        for part, raw in zip(b.column("part").to_pylist(), decompressed(b.column("counts")), strict=True):
            x = np.frombuffer(raw, "<i8")
            sums[part] = sums[part] + x if part in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([z.compress(x.tobytes()) for x in sums.values()], pa.binary())], ["part", "counts"])


def _sketch(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """By slot: the class of frequency (uint8), and by class the estimated documents. 1 MB whatever the input."""
    rows = survey.where("part IS NOT NULL").select("part", "counts").repartition("part").mapInArrow(_sum_parts, "part int, counts binary").collect()
    import zstandard

    counts = np.zeros(1 << SLOTS, np.int64)
    for r in rows:
        counts.reshape(PARTS, -1)[r.part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts), "<i8")
    usual = np.median(counts)
    classes = np.floor(4 * np.log2(counts + 1)).astype(np.uint8)
    return classes, np.maximum(2.0 ** (np.arange(256) / 4) - usual, 1.0)


def _postings(docs: DataFrame, spec: Shingles, sketch) -> DataFrame:
    """(token, sk, meta) of the prefixes of all sets: meta is size, place (24 bits), early (1 bit) and need (7 bits). A set is taken once per task.

    Places from 2**24 on count as that: they are only used for bounds, which get wider, and for some order within a set, whichever it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        classes, likely = shared.value
        seen = set()
        for b in batches:
            data, off = utf8(b.column("text"))
            for i, j in chunks(off):
                row, h = spec.sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                at, size, sk = _keys(row, h, j - i)
                c = classes[h >> np.uint64(64 - SLOTS)]
                k = np.lexsort((h, c, row))
                h, c = h[k], c[k]
                least = -(-spec.percent * size // 100)
                base = size - least  # of a prefix, beside its need
                cost = np.concatenate(([0.0], np.cumsum(likely[c])))
                best, need = np.full(len(size), np.inf), np.ones(len(size), np.int64)
                for n in range(1, MOST_NEED + 1):
                    read = cost[np.minimum(at[:-1] + base + n, at[1:])] - cost[at[:-1]]
                    now = np.where(n <= np.maximum(least, 1), read * (1 + VERIFY / n), np.inf)
                    need = np.where(now < best, n, need)
                    best = np.minimum(now, best)
                take = np.array([s > 0 and not (x in seen or seen.add(x)) for x, s in zip(sk.tolist(), size.tolist(), strict=True)], bool)
                long = np.where(take, np.minimum(base + need, size), 0)
                where = np.arange(long.sum()) + np.repeat(at[:-1] - (np.cumsum(long) - long), long)
                first = _early(size, spec.percent, lambda x: np.ceil(x).astype(np.int64), lambda x: np.floor(x).astype(np.int64))
                place = where - np.repeat(at[:-1], long)
                early = (place < np.repeat(first + need - 1, long)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[where].view(np.int64)), pa.array(np.repeat(sk, long)), pa.array(np.repeat((size << 32) | need, long) | (np.minimum(place, (1 << 24) - 1) << 8) | (early << 7))],
                    ["token", "sk", "meta"],
                )

    return docs.mapInArrow(lean(run), "token long, sk long, meta long")


def _texts(docs: DataFrame, spec: Shingles) -> DataFrame:
    """(sk, z): the compressed text of each set, once per task."""

    def run(batches):
        import zstandard

        z, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            data, off = utf8(b.column("text"))
            raw = memoryview(data)
            for i, j in chunks(off):
                row, h = spec.sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                _, size, sk = _keys(row, h, j - i)
                take = [k for k, (x, s) in enumerate(zip(sk.tolist(), size.tolist(), strict=True)) if s and not (x in seen or seen.add(x))]
                yield pa.RecordBatch.from_arrays([pa.array(sk[take]), pa.array([z.compress(raw[off[i + k] : off[i + k + 1]]) for k in take], pa.binary())], ["sk", "z"])

    return docs.mapInArrow(lean(run), "sk long, z binary")


def _verified(pairs: DataFrame, texts: DataFrame, spec: Shingles) -> DataFrame:
    """Those of the pairs (a, b) that link, compared by their whole sets."""

    def run(batches):
        for b in batches:
            for k in range(0, len(b), 1000):
                part = b.slice(k, 1000)
                a, c = part.column("a").to_pylist(), part.column("b").to_pylist()
                z = dict(zip(a + c, part.column("za").to_pylist() + part.column("zb").to_pylist(), strict=True))
                number = {x: i for i, x in enumerate(z)}
                data, off = utf8(pa.array(decompressed(pa.array(list(z.values()), pa.binary())), pa.large_binary()))
                sets = []
                for i, j in chunks(off):
                    row, h = spec.sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    sets += np.split(h, np.searchsorted(row, np.arange(1, j - i)))
                links = []
                for i, (x, y) in enumerate(zip(a, c, strict=True)):
                    x, y = sets[number[x]], sets[number[y]]
                    x, y = (x, y) if len(x) < len(y) else (y, x)
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= spec.percent * (len(x) + len(y) - both):
                        links.append(i)
                yield part.select(["a", "b"]).take(pa.array(links, pa.int64()))

    joined = pairs.join(texts.select(F.col("sk").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("sk").alias("b"), F.col("z").alias("zb")), "b")
    return joined.select("a", "b", "za", "zb").mapInArrow(lean(run), "a long, b long")


def _needed(size, other, percent: int, ceil):
    """Places in a set before which a shingle shared with a similar set of size `other` is in the other's prefix."""
    return ceil(percent * (size + other) / (100 + percent)) - ceil(percent * other / 100) + 1


def _early(size, percent: int, ceil, floor):
    """The same for sizes up to 3 % larger."""
    return _needed(size, floor(size * 103 / 100), percent, ceil)


def _fits(x: str, y: str, percent: int):
    """Whether sets x and y may be similar enough, by their sizes and the early shingles that they have alone."""

    def most(x, y):
        size, other = F.col(f"size{x}"), F.col(f"size{y}")
        there = _needed(size, other, percent, F.ceil) + F.col(f"need{y}") >= _early(size, percent, F.ceil, F.floor) + F.col(f"need{x}")
        return size - F.when(there, F.col(f"alone{x}")).otherwise(0)

    size, other = F.col(f"size{x}"), F.col(f"size{y}")
    return (100 * F.least(size, other) >= percent * F.greatest(size, other)) & ((100 + percent) * F.least(most(x, y), most(y, x)) >= percent * (size + other))


def _entries(docs: DataFrame, spec: Shingles, sketch, stage) -> DataFrame:
    """(token, sk, place, before, facts): prefix shingles that several sets have in their prefixes, with the one before it in the set; facts: _facts."""
    postings = _postings(docs, spec, sketch).repartition("token").groupBy("token", "sk").agg(F.max("meta").alias("meta"))
    lists = postings.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1").drop("n")
    bits = lambda shift, n: F.shiftright("meta", shift).bitwiseAND(F.lit((1 << n) - 1))
    size, need, of = F.shiftright("meta", 32), bits(0, 7), Window.partitionBy("sk")
    alone = F.least(size, _early(size, spec.percent, F.ceil, F.floor) + need - 1) - F.sum(bits(7, 1)).over(of)
    lists = lists.withColumns({"place": bits(8, 24).cast("int"), "before": F.lag("token").over(of.orderBy(bits(8, 24))), "facts": F.shiftleft(size, 31).bitwiseOR(F.shiftleft(F.least(alone, F.lit((1 << 24) - 1)).cast("long"), 7)).bitwiseOR(need)})
    return stage(lists.select("token", "sk", "place", "before", "facts"), "entries")


def _facts(df: DataFrame, *sides: str) -> DataFrame:
    """size, alone and need of each side, from its facts."""
    for s in sides:
        f = f"facts{s}"
        df = df.withColumns({f"size{s}": F.shiftright(f, 31), f"alone{s}": F.shiftright(f, 7).bitwiseAND(F.lit((1 << 24) - 1)), f"need{s}": F.col(f).bitwiseAND(F.lit(127))})
    return df


def _sharing(pairs: DataFrame, entries: DataFrame, spec: Shingles) -> DataFrame:
    """Those of the pairs (a, b, factsx, factsy) that share enough prefix shingles, and may share enough of what comes after the last of these."""
    prefix = entries.groupBy("sk").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("p"))
    both = pairs.join(prefix.select(F.col("sk").alias("a"), F.col("p").alias("px")), "a").join(prefix.select(F.col("sk").alias("b"), F.col("p").alias("py")), "b")
    both = _facts(both, "x", "y").withColumn("shared", F.array_intersect("px.token", "py.token"))
    place = lambda s: F.element_at(F.col(f"p{s}.place"), F.array_position(F.col(f"p{s}.token"), F.element_at("shared", -1)).cast("int"))
    most = F.size("shared") + F.least(F.col("sizex") - place("x"), F.col("sizey") - place("y")) - 1
    enough = (F.size("shared") >= F.least("needx", "needy")) & ((100 + spec.percent) * most >= spec.percent * (F.col("sizex") + F.col("sizey")))
    return both.where(enough).select("a", "b")


def _rooted(docs: DataFrame, spec: Shingles) -> DataFrame:
    """doc_id (NULL_ID if null), tk, size and root (the smallest set that links reach) of each row of docs, staged; what it took to find them is deleted."""
    with scratch(docs.sparkSession) as folders:
        return staged(_found_roots(docs, spec, lambda df, name: staged(df, name, folders)), "rooted")


def _found_roots(docs: DataFrame, spec: Shingles, stage) -> DataFrame:
    own = keyed(docs)
    survey = stage(_survey(own, spec), "survey")
    rows = survey.where("part IS NULL").select("doc_id", "tk", "sk", "size")
    entries = full = _entries(own, spec, _sketch(survey), stage)
    texts = stage(_texts(own, spec).join(entries.select("sk").distinct(), "sk", "left_semi").groupBy("sk").agg(F.first("z").alias("z")), "texts")
    edges, roots, by = None, None, Window.partitionBy("token")
    for r in range(ROUNDS + 1):
        # only lists that still hold different components; main is a list's largest
        named = entries.withColumn("root", F.col("sk")) if roots is None else entries.join(roots.withColumnRenamed("node", "sk"), "sk", "left").withColumn("root", F.coalesce("root", "sk"))
        named = named.repartition("token").withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("token", "root")))
        named = named.withColumns({"main": F.max(F.struct("own", "root")).over(by)["root"], "low": F.min("root").over(by), "high": F.max("root").over(by)})
        named = stage(named.where("low <> high").drop("low", "high", "own"), "named")
        entries = named.drop("root", "main")
        if named.isEmpty():
            break
        if last := r == ROUNDS:
            beside = F.col("root") != F.col("main")
            x, y = (_facts(named.select("token", beside.alias("beside" + s), *[F.col(c).alias(c + s) for c in ("sk", "root", "place", "before", "facts")]), s) for s in "xy")
            # a pair is formed at its first common shingle: what stands before that is not common
            first = ~F.col("beforex").eqNullSafe(F.col("beforey")) | F.col("beforex").isNull()
            rest = F.least(F.col("sizex") - F.col("placex"), F.col("sizey") - F.col("placey"))
            first = first & ((100 + spec.percent) * rest >= spec.percent * (F.col("sizex") + F.col("sizey")))
            other = (F.col("rootx") != F.col("rooty")) & first & (~F.col("besidey") | (F.col("skx") < F.col("sky"))) & _fits("x", "y", spec.percent)
            pairs = x.where("besidex").join(y, (x.token == y.token) & other)
            less = F.col("skx") < F.col("sky")
            pairs = pairs.select(F.least("skx", "sky").alias("a"), F.greatest("skx", "sky").alias("b"), *[F.when(less, F.col(f"facts{s}")).otherwise(F.col(f"facts{t}")).alias(f"facts{s}") for s, t in ("xy", "yx")])
            pairs = _sharing(pairs.distinct(), full, spec)
        else:
            turn = F.struct(F.shiftright("facts", 7).bitwiseAND(F.lit((1 << 24) - 1)) if r == 0 else F.lit(0), F.xxhash64("sk", F.lit(r)))
            lead = named.withColumn("y", F.min_by(F.struct("sk", "facts", "root"), turn).over(by))
            lead = _facts(lead.select("sk", "root", F.col("facts").alias("factsx"), F.col("y.sk").alias("b"), F.col("y.facts").alias("factsy"), F.col("y.root").alias("root_b")), "x", "y")
            lead = lead.where((F.col("root_b") != F.col("root")) & _fits("x", "y", spec.percent)).groupBy(F.col("sk").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
            pairs = lead.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("nth <= 2").select("a", "b")
        new = stage(_verified(pairs, texts, spec), "links")
        edges = new if edges is None else edges.unionByName(new)
        roots = components(edges, stage)
        if last:
            break
    out = rows.withColumn("root", F.col("sk"))
    if roots is not None:
        out = rows.join(roots.withColumnRenamed("node", "sk"), "sk", "left").withColumn("root", F.coalesce("root", "sk"))
    return out.select("doc_id", "tk", "size", "root")


def groups(docs: DataFrame, spec: Shingles = Shingles()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row of docs."""
    out = _rooted(docs, spec)
    low = out.where("size > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = out.join(low, "root", "left").withColumn("least", F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select(real_id(), F.col("size").alias("n_shingles"), F.when(F.col("least") != NULL_ID, F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, spec: Shingles = Shingles()) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, of several the one of the smallest hash of its text. All columns stay.

    Rows are told apart by doc_id and text, so unrelated texts that share a doc_id, or have none, each stay. Rows without words are linked with nothing:
    all of them stay. Texts move compressed.
    """
    first = _rooted(docs, spec).where("size > 0").groupBy("root").agg(F.min(F.struct("doc_id", "tk")).alias("first"))
    stay = first.select(F.col("first.doc_id").alias("__id"), F.col("first.tk").alias("__tk"))
    at, columns = docs.columns.index("text"), docs.columns

    def pack(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            blobs = [None if t is None else z.compress(t.encode()) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blobs, pa.binary())], [*columns, "__z"]).drop_columns([columns[at]])

    def unpack(batches):
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            out = b.drop_columns(["__z"]).columns
            out.insert(at, pa.array([None if x is None else d.decompress(x).decode() for x in b.column("__z").to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays(out, columns)

    from pyspark.sql.types import BinaryType, StructField, StructType

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wordy = text.rlike("[^\\x20\\x09-\\x0D]")
    own = docs.where(wordy).withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "__tk": F.xxhash64(F.col("text").cast("string"))})
    columns = own.columns
    fields = [f for f in own.schema.fields if f.name != "text"]
    packed = own.mapInArrow(lean(pack), StructType([*fields, StructField("__z", BinaryType())]))
    rows = packed.join(stay, ["__id", "__tk"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("__id", "__tk").orderBy(F.xxhash64("__z")))
    kept = rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth").select(*[f.name for f in fields], "__z").mapInArrow(lean(unpack), own.schema)
    return kept.select(*docs.columns).unionByName(docs.where(~wordy))


CONTRACT = Shingles(4, 85)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), CONTRACT)


def sql_of(spec: Shingles) -> str:
    """All pairs that share a shingle, which is for small tables."""
    return f"""WITH RECURSIVE
d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + {spec.size} - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {spec.size} + 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * both_have >= {spec.percent} * (a.n + b.n - both_have)),
r AS (SELECT rid, doc_id AS low FROM d UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.rid),
c AS (SELECT rid, min(low) AS component_id FROM r GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)"""

QUERIES = {"op8_jaccard_join": op8_jaccard_join}
SQL = {"op8_jaccard_join": sql_of(CONTRACT)}
