"""Merkle manifest of a dataset: a leaf for each row, a tree for each part, a tree over the parts' roots, and a proof for each row.

Rows get their rank in their part from a range partitioning: places within a partition plus what lies before it, so that no part is sorted in one task. The
ranks' digits (base `FAN`) are then grouped away one after another: the nodes of a run become an array of structs inside their parent. That goes on within
a block of `FAN ** DEPTH` rows, which is dealt to its task by one shuffle and whose size doesn't grow; the blocks' roots are the rows of the next round, and
after the last one each part is a row, and the parts are ranked and rolled up likewise.

Proofs are emitted from the nested structs by transform and explode, from the root down; rows meet nothing else for that. Only blocks (one row for 4,096)
meet what stands above them, in a join by part and number.

A leaf is the hash of its fields, each "-" if null and otherwise its length in UTF-8 bytes, a colon, and its value. Within a part, leaves ascend by key (nulls
first), then by hash; equal rows are interchangeable. Null parts are a part, before all others. Rows whose key is null are never tampered with. A part of
one row has that leaf as its subroot, and a dataset of one part that subroot as its root. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, staged, table

#: Nodes of a run, and levels within a block.
FAN, DEPTH = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """The hash of the fields, in their order."""
    texts = [c.cast("string") for c in fields.values()]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(part, key, leaf, other): other is the leaf of the row as `tampered` (a text in place of its own, or null for none) makes it."""
    fields = {f: F.col(f) for f in FIELDS}
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf({**fields, "text": tampered}))
    part = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # "-" comes before "="
    return docs.select(part.alias("part"), F.col("doc_id").cast("long").alias("key"), leaf(fields).alias("leaf"), other.alias("other"))


def _ranked(nodes: DataFrame, stage) -> DataFrame:
    """part, n (of its nodes), rank (from 0), h and own (the other columns) of nodes (part, key, leaf, ...)."""
    own = stage(nodes.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "leaves")  # parts equal rows
    order = ["part", "key", "leaf", "salt"]
    placed = stage(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    piece = F.shiftright("at", 33)
    pieces = placed.groupBy("part", piece.alias("piece")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each partition and part
    by = Window.partitionBy("part")
    before = F.coalesce(F.sum("n").over(by.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("part", "piece", (before - F.col("first")).alias("shift"), F.sum("n").over(by).alias("n"))
    rows = placed.withColumn("piece", piece).join(pieces, ["part", "piece"])
    more = [c for c in nodes.columns if c not in ("part", "leaf")]
    return rows.select("part", "n", (F.col("at") + F.col("shift")).alias("rank"), F.col("leaf").alias("h"), F.struct(*more).alias("own"))


def _level(n: Column, k: int) -> Column:
    """How many nodes are left after k levels, of n."""
    return F.ceil(n / (FAN**k)).cast("long")


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """part, n, rank, h and kids (nested DEPTH levels deep) of the blocks of nodes (part, n, rank, h, own)."""
    digits = [F.floor(F.col("rank") / FAN**k).cast("long").alias(f"r{k}") for k in range(DEPTH + 1)]
    level = nodes.select("part", "n", *digits, "h", "own").repartition("part", f"r{DEPTH}")
    for k in range(1, DEPTH + 1):
        kid = F.struct(F.col(f"r{k - 1}").alias("at"), "h", F.col("own" if k == 1 else "kids").alias("below"))
        level = level.groupBy("part", "n", *[f"r{j}" for j in range(k, DEPTH + 1)]).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        level = level.withColumn("h", F.when(_level(F.col("n"), k - 1) > 1, F.sha2(F.array_join("kids.h", ""), 256)).otherwise(F.col("kids")[0]["h"]))
    return level.select("part", "n", F.col(f"r{DEPTH}").alias("rank"), "h", "kids")


def _emitted(blocks: DataFrame) -> DataFrame:
    """The nodes of blocks (part, n, kids, path and more), with the siblings of their runs before the path: an array of steps, from below."""
    more = [c for c in blocks.columns if c not in ("part", "n", "rank", "h", "kids", "path")]
    level = blocks
    for k in range(DEPTH, 0, -1):
        around = lambda kid, i: F.struct(kid.alias("kid"), F.struct(F.array_join(F.slice(F.col("hs"), F.lit(1), i), "").alias("before"), F.array_join(F.slice(F.col("hs"), i + 2, F.lit(FAN)), "").alias("after")).alias("step"))
        level = level.withColumn("hs", F.col("kids.h")).withColumn("it", F.explode(F.transform("kids", around)))
        path = F.when(_level(F.col("n"), k - 1) > 1, F.concat(F.array("it.step"), "path")).otherwise(F.col("path"))
        kid = F.col("it.kid")
        level = level.select("part", "n", kid["at"].alias("rank"), kid["h"].alias("h"), kid["below"].alias("kids"), path.alias("path"), *more)
    return level.withColumnRenamed("kids", "own")


def _proofs(nodes: DataFrame, above, stage) -> DataFrame:
    """part, rank, h, own, path and what above gives, for each of nodes (part, n, rank, h, own). above: (part, h) of each part -> part, path and more."""
    rounds = []
    while True:
        blocks = stage(_rolled_up(nodes), "blocks")
        rounds.append(blocks)
        left = _level(F.col("n"), DEPTH)
        if (blocks.agg(F.max(left)).first()[0] or 0) <= 1:
            break
        nodes = blocks.select("part", left.alias("n"), "rank", "h", F.lit(0).alias("own"))
    tops = above(rounds[-1].select("part", "h"))
    out = _emitted(rounds[-1].join(tops, "part"))
    for blocks in reversed(rounds[:-1]):
        out = _emitted(blocks.join(stage(out.drop("n", "h", "own"), "above"), ["part", "rank"]))
    return out.drop("n")


def proofs(rows: DataFrame, stage) -> DataFrame:
    """part, key, leaf, path (steps from below: what the siblings before and after a node of each run concatenate to), subroot, root and the other columns.

    rows: leaves(). stage(df, name) stores and rereads; what it stored must stay for as long as the result is read.
    """

    def alone(tops):
        return tops.select("part", F.expr("cast(array() AS array<struct<before: string, after: string>>)").alias("path"), F.col("h").alias("root"))

    def joined(tops):
        tops = stage(tops, "subroots")
        parts = tops.select(F.lit("").alias("part"), F.col("part").alias("key"), F.col("h").alias("leaf"))
        return _proofs(_ranked(parts, stage), alone, stage).select(F.col("own.key").alias("part"), "path", F.col("h").alias("subroot"), "root")

    out = _proofs(_ranked(rows, stage), joined, stage)
    return out.select("part", "own.*", F.col("h").alias("leaf"), "path", "subroot", "root")


def siblings(path: Column) -> Column:
    """All siblings of a proof, from below, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(path, start, lambda h, s: digest(s["before"], h, s["after"]))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row, where `tampered` is checked in place of the row's text."""
    with scratch(docs.sparkSession) as folders:
        out = proofs(leaves(docs, tampered), lambda df, name: staged(df, name, folders))
        out = out.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
        out = out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
        return staged(out, "manifest")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """A third of the documents, by the checksum of doc_id, is checked with lower-case letters in place of A-Z."""
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER))
    return manifest(table(spark, sf_dir, "documents"), F.when(F.col("text").isNull(), None).otherwise(lowered))


#: Levels of the comparison in SQL: up to 8**7 rows of a language, and 8**3 languages.
_LEVELS, _PARTS = 7, 3


def _tree(name: str, levels: int) -> str:
    """Levels name0 (part, idx, h, n) to name{levels}, and the steps from each to the next."""
    out = []
    for k in range(levels):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT part, idx // {FAN} AS idx, list(h ORDER BY idx) AS hs, any_value(n) AS n FROM {name}{k} GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT part, idx, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (n + {FAN - 1}) // {FAN} AS n FROM {name}r{k})")
    return ",\n".join(out)


def _climb(name: str, first: str, start: str, levels: int) -> str:
    """start with proof and folded after all levels, as first0 to first{levels}; it has part, idx, proof and folded."""
    out = [f"{first}0 AS ({start})"]
    for k in range(levels):
        pos = f"(s.idx % {FAN})"
        before, after = f"array_to_string(r.hs[1:{pos}], '')", f"array_to_string(r.hs[{pos} + 2:], '')"
        out.append(f"""{first}{k + 1} AS (SELECT s.* REPLACE (s.idx // {FAN} AS idx, CASE WHEN r.n > 1 THEN s.proof || {before} || {after} ELSE s.proof END AS proof,
    CASE WHEN r.n > 1 THEN sha256({before} || s.folded || {after}) ELSE s.folded END AS folded) FROM {first}{k} s JOIN {name}r{k} r ON r.part = s.part AND r.idx = s.idx // {FAN})""")
    return ",\n".join(out)


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"


SQL_OP12 = f"""WITH
d AS (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS low, coalesce('=' || lang, '-') AS part,
    xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM documents),
h AS (SELECT doc_id, part, sha256({" || ".join(map(_field, FIELDS))}) AS leaf,
    CASE WHEN text IS NOT NULL AND crc % 3 = 0 THEN sha256({" || ".join(_field("low" if f == "text" else f) for f in FIELDS)}) END AS other FROM d),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY part) AS n FROM h),
a0 AS (SELECT part, idx, leaf AS h, n FROM p),
{_tree("a", _LEVELS)},
b0 AS (SELECT '' AS part, row_number() OVER (ORDER BY encode(part)) - 1 AS idx, h, count(*) OVER () AS n, part AS own FROM a{_LEVELS}),
{_tree("b", _PARTS)},
{_climb("a", "f", "SELECT doc_id, leaf, part, idx, '' AS proof, coalesce(other, leaf) AS folded FROM p", _LEVELS)},
{_climb("b", "g", f"SELECT f.doc_id, f.leaf, b.h AS subroot, b.part, b.idx, f.proof, f.folded FROM f{_LEVELS} f JOIN b0 b ON b.own = f.part", _PARTS)}
SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b.h AS verified FROM g{_PARTS} g, b{_PARTS} b"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
SQL = {"op12_merkle_manifest": SQL_OP12}
