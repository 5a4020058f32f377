"""Exact repeated windows (of bytes or of words), found through sampled anchors that are kept in sorted runs.

Every window of `window` units holds `window - gram + 1` runs of `gram` units; the one with the smallest hash is its anchor, so equal windows have equal
anchors at the same place inside them. Neighbouring windows mostly share an anchor: such a group is one sampled suffix. Per group there is one
fingerprint (a, h): a hashes the anchor, h the whole stretch that the group's windows cover. That is one for about window / 2 units.

1. A batch's fingerprints are written as a sorted run (runs.py): one for each document, or (where all repeats go) summed per task, so that a group of
   copies or a passage in a third of all documents is one row of each task.
2. The run is scanned together with the sorted runs of history: equal (a, h) means that the whole stretch repeats; an a of one stretch only means that no
   window of its group does; what is left (the ends of repeated passages, and frequent phrases) is unclear. Only what says something is kept.
3. What concerns a document goes to it. Documents resolve their stretches, and emit the single windows where it is unclear; documents of history are
   resolved again only for the windows they share an anchor with.
4. The windows of each stretch (one row, with their hashes) are compared with others of the same anchor, anchor by anchor in the order of anchors, and what
   repeats goes back to the documents that asked. Anchors of too many stretches for one task are compared by (anchor, hash) instead.

Sums carry second hashes of their stretches, and equal (a, h) whose second hashes differ are not taken as repeats: all their windows are unclear.

A row's key is a hash of its doc_id and text (`tie`), and the doc_id too if that decides which window stays. Rows of one key are equal in both: one of them
is looked at (`once`), and its result goes to all.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, compressed, decompressed, keyed, real_id, utf8
from .runs import ROWS, SUMS
from .text import SPACE, Runs, byte_runs, covered, intervals, mix, starts_of_windows, word_hashes, words

#: Bits of a unit's place in the sliding minimum, windows looked at together, and fingerprints that a task sums at a time.
PLACE, PART, SUMMED = 26, 1 << 24, 1 << 20
#: Marks of a stretch: it repeats; its windows are unclear; its windows may be what others repeat.
REPEATS, UNCLEAR, SOURCE = 1, 2, 4
#: Ids shared by several rows that are broadcast; above that, all rows get a tie (more bytes to shuffle, the same results).
SHARED = 100_000
#: Windows that a task compares at a time, and the most of one anchor that it holds.
COMPARED, HELD = 1 << 20, 1 << 22


@dataclass(frozen=True)
class Repeats:
    """unit: "byte" or "word". first_stays: a window repeats if an earlier document has it, else if it starts anywhere else too."""

    unit: str
    window: int
    gram: int
    first_stays: bool

    @property
    def key(self) -> list[str]:
        return ["doc_id", "tie"] if self.first_stays else ["tie"]

    @property
    def schema(self) -> str:
        """Of a run."""
        return ROWS if self.first_stays else SUMS

    def units(self, data: np.ndarray, off: np.ndarray):
        """Hashes of runs and n + 1 offsets of the rows' units, and the words' bounds in bytes."""
        if self.unit == "byte":
            return byte_runs(data, min(self.gram, self.window)), off, None
        start, end, at = words(data, off, ~SPACE)
        return Runs(word_hashes(data, start, end)), at, (start, end)

    def groups(self, runs: Runs, at: np.ndarray):
        """row, a, h, first and last window start of each group of windows that share an anchor."""
        grams = runs.each(self.gram)
        starts, out = starts_of_windows(at, self.window), []
        for k in range(0, len(starts), PART):
            s = starts[k : k + PART]
            low = int(s[0])
            g = grams[low : int(s[-1]) + self.window - self.gram + 1]
            m = (g >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(g), dtype=np.uint64)
            width, want = 1, self.window - self.gram + 1
            while width < want:  # minima over `width` runs, doubled
                step = min(width, want - width)
                m = np.minimum(m[: len(m) - step], m[step:])
                width += step
            place = low + (m[s - low] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
            new = np.flatnonzero((place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1)) + 1
            first, last = s[np.concatenate(([0], new))], s[np.concatenate((new - 1, [len(s) - 1]))]
            place = place[np.concatenate(([0], new))]
            h = runs.of(first, last + self.window) ^ ((place - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            out.append((np.searchsorted(at, first, "right") - 1, grams[place], h, first, last))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 2]

    def second(self, data: np.ndarray, bounds, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Another hash of the groups' stretches, from the words."""
        return Runs(word_hashes(data, *bounds, seed=1)).of(first, last + self.window).view(np.int64)


def tied(docs: DataFrame, few: bool = False) -> DataFrame:
    """The keyed docs with tie, a hash of doc_id and text. few: zero (which compresses well) for ids of one row only; comparable within docs alone."""
    own = keyed(docs)
    tie = F.xxhash64("doc_id", "text")
    if few:
        ids = own.groupBy("doc_id").count().where((F.col("count") > 1) & (F.col("doc_id") != NULL_ID)).select("doc_id").limit(SHARED + 1).collect()
        if len(ids) <= SHARED:
            shared = own.sparkSession.createDataFrame([(r.doc_id, True) for r in ids], "doc_id long, several boolean")
            own = own.join(F.broadcast(shared), "doc_id", "left") if ids else own.withColumn("several", F.lit(None).cast("boolean"))
            tie = F.when(F.col("several") | (F.col("doc_id") == NULL_ID), tie).otherwise(0)
    return own.select("doc_id", tie.cast("long").alias("tie"), "text")


KEY = ["doc_id", "tie"]


def once(own: DataFrame, stage) -> tuple[DataFrame, DataFrame | None]:
    """The tied rows, one for each key, and the keys of several rows (None if there are none). Only rows of such keys are shuffled."""
    again = stage(own.groupBy(*KEY).count().where("count > 1").select(*KEY), "again")
    n = again.limit(SHARED + 1).count()
    if not n:
        return own, None
    keys = F.broadcast(again) if n <= SHARED else again
    one = own.join(keys, KEY, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text"))
    return own.join(keys, KEY, "left_anti").unionByName(one), again


def _groups_of(docs: DataFrame, spec: Repeats, key: list[str], second: bool, emit, schema: str) -> DataFrame:
    """emit(arrays) of a, h, the columns of key and (second) another hash of each group of docs, some documents at a time."""

    def run(batches):
        for b in batches:
            data, off = utf8(b.column("text"))
            keys = [b.column(c).to_numpy() for c in key]
            for i, j in chunks(off):
                part = data[off[i] : off[j]]
                runs, at, bounds = spec.units(part, off[i : j + 1] - off[i])
                row, a, h, first, last = spec.groups(runs, at)
                check = [spec.second(part, bounds, first, last)] if second else []
                yield [a, h, *[k[i:j][row] for k in keys], *check]

    names = [c.split()[0] for c in schema.split(", ")]
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in x], names)
    return docs.select(*key, "text").mapInArrow(lambda batches: map(batch, emit(run(batches))), schema)


def _once(parts):
    """Each (a, h) of a document once, so that what a document says over and over is one row."""
    for a, h, doc_id, tie in parts:
        o = np.argsort(a + h * np.uint64(0x9E3779B97F4A7C15))
        a, h, doc_id, tie = a[o], h[o], doc_id[o], tie[o]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1]) | (doc_id[1:] != doc_id[:-1]) | (tie[1:] != tie[:-1])
        yield [a[new], h[new], doc_id[new], tie[new]]


def _summed(parts):
    def sums(a, h, k, check):
        o = np.argsort(a + h * np.uint64(0x9E3779B97F4A7C15))
        a, h, k, check = a[o], h[o], k[o], check[o]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1]))))
        both = lambda x: [np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)]
        return [a[at], h[at], np.diff(at, append=len(a)), *both(k), *both(check)]

    some, size = [], 0
    for p in parts:
        some.append(p)
        size += len(p[0])
        if size >= SUMMED:
            yield sums(*[np.concatenate(x) for x in zip(*some, strict=True)])
            some, size = [], 0
    if size:
        yield sums(*[np.concatenate(x) for x in zip(*some, strict=True)])


def fingerprints(docs: DataFrame, spec: Repeats) -> DataFrame:
    """The rows of a run (spec.schema) of the tied docs."""
    if spec.first_stays:
        return _groups_of(docs, spec, ["doc_id", "tie"], False, _once, ROWS)
    return _groups_of(docs, spec, ["tie"], True, _summed, SUMS)


#: What a scan finds, for documents: (doc_id, tie, h, bits), where bits without doc_id are for documents of history that have to be resolved again.
MARKS = ["doc_id", "tie", "h", "bits", "is_new"]
#: What a scan of sums finds: `whole` for all rows that have the stretch (and the second hash `check`), `ends` for that of key `own`; `other` has it, too.
FOUND = ["a", "h", "own", "other", "whole", "ends", "check"]


def scanned_rows(rows: DataFrame) -> DataFrame:
    """MARKS of the new rows, and of rows of history that hold what new ones may repeat, from a run of new rows beside those of history."""
    by_a, by_h, new = Window.partitionBy("a"), Window.partitionBy("a", "h"), F.col("is_new")
    u = rows.withColumns({"own": F.min(F.when(new, F.col("doc_id"))).over(by_h), "old": F.min(F.when(~new, F.col("doc_id"))).over(by_h)})
    only_new = F.col("old").isNull()
    mine = F.when(only_new, F.col("own"))
    u = u.withColumns({"any_old": F.max(~only_new).over(by_a), "least": F.min(mine).over(by_a), "most": F.max(mine).over(by_a)})
    ends = F.when(F.col("any_old") | (F.col("least") < F.col("own")), UNCLEAR).otherwise(0).bitwiseOR(F.when(F.col("most") > F.col("own"), SOURCE).otherwise(0))
    bits = F.when(new, F.when(~only_new | (F.col("doc_id") > F.col("own")), REPEATS).otherwise(ends))
    bits = bits.when(~new & (F.col("doc_id") == F.col("old")) & F.col("least").isNotNull(), SOURCE).otherwise(0)
    return u.withColumn("bits", bits).where("bits > 0").select(*MARKS)


def scanned_sums(rows: DataFrame) -> DataFrame:
    """FOUND, from sums of new rows beside those of history. All windows share one order, that of runs."""
    by_a, by_h = Window.partitionBy("a"), Window.partitionBy("a", "h")
    u = rows.withColumns({"n": F.sum("n").over(by_h), "own": F.min("first").over(by_h), "other": F.max("last").over(by_h), "check": F.min("low").over(by_h), "__high": F.max("high").over(by_h)})
    u = u.withColumn("clash", F.coalesce(F.col("check") != F.col("__high"), F.lit(False)))
    u = u.withColumns({
        "several": F.min("h").over(by_a) != F.max("h").over(by_a), "single": F.min(F.when(F.col("clash"), 1).otherwise(F.col("n"))).over(by_a) == 1,
        "any_new": F.max("is_new").over(by_a), "again": F.lag("h").over(by_a.orderBy("h")).eqNullSafe(F.col("h")),
    })
    ends = F.when(F.col("several") & F.col("single"), F.when(F.col("n") == 1, UNCLEAR).otherwise(SOURCE)).otherwise(0)
    whole = F.when(F.col("clash"), UNCLEAR).when(F.col("n") > 1, REPEATS).otherwise(0)
    return u.withColumns({"whole": whole, "ends": ends}).where("any_new AND NOT again AND (whole > 0 OR ends > 0)").select(*FOUND)


def _collected(marks: DataFrame, key: list[str]) -> DataFrame:
    """key and marks: h of each stretch that the row of that key has to look at, with its bits in place of the lowest three."""
    mark = F.shiftleft(F.shiftright("h", 3), 3).bitwiseOR(F.col("bits").cast("long"))
    return marks.where("bits > 0").select(*key, mark.alias("mark")).groupBy(*key).agg(F.collect_set("mark").alias("marks"))


def marks_of(own: DataFrame, found: DataFrame, spec: Repeats) -> DataFrame:
    """(a, tie, h, bits) of the tied docs, from what scans of sums found."""
    whole = F.when((F.col("whole") == REPEATS) & (F.col("check") != F.col("own_check")), UNCLEAR).otherwise(F.col("whole"))
    bits = whole.bitwiseOR(F.when(F.col("tie") == F.col("own"), F.col("ends")).otherwise(0))
    placed = _groups_of(own, spec, ["tie"], True, lambda parts: parts, "a long, h long, tie long, own_check long")
    return placed.join(found.select("a", "h", "own", "whole", "ends", "check"), ["a", "h"]).select("a", "tie", "h", bits.alias("bits")).where("bits > 0")


RESULT = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept string, tie long"
_DOC = f"{RESULT}, z binary, removed array<long>"
#: Stretches: ref: the first window's start, and whether windows are judged in a higher bit; ws: the hashes of their windows, 8 bytes each.
_WINDOWS = "a long, ref long, ws binary"
_JUDGED = 1 << 62


def _row(spec: Repeats, raw: bytes, n: int, bounds, mask: np.ndarray, text: bool) -> tuple:
    """n_units, n_removed, n_spans, kept_sha256, kept."""
    s, e = intervals(mask)
    if spec.unit == "byte":
        cut, last = [], 0
        for x, y in zip(s.tolist(), e.tolist(), strict=True):
            cut.append(raw[last:x])
            last = y
        kept = b"".join([*cut, raw[last:]])
    else:
        start, end = bounds
        keep = ~mask
        kept = b" ".join([raw[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist(), strict=True)])
    return n, int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if text else None


def _whole(spec: Repeats, raw: bytes, text: bool) -> tuple:
    """The same for a text that keeps all."""
    own = None if spec.unit == "byte" else raw.split()  # at the white space of the word rule
    kept = raw if own is None else b" ".join(own)
    return len(raw) if own is None else len(own), 0, 0, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if text else None


def _resolver(spec: Repeats, text: bool, arrow_schema, asked: bool):
    """Rows with marks become rows of results (or, where windows must be looked up first, of what is known), and rows of windows. asked: else windows only."""

    def table(docs, wins):
        cols = list(zip(*docs, strict=True)) or [()] * 9
        n, fields = len(docs), list(arrow_schema)
        arrays = [pa.array(c, f.type) for c, f in zip(cols, fields[:9], strict=True)]
        if wins:
            doc, tie, a, ref = (np.concatenate(x) for x in list(zip(*wins, strict=True))[:4])
            m = len(doc)
            arrays = [pa.concat_arrays([x, pa.array({0: doc, 6: tie}[k]) if k in (0, 6) else pa.nulls(m, x.type)]) for k, x in enumerate(arrays)]
            more = [pa.array(a), pa.array(ref), pa.concat_arrays([x[4] for x in wins])]
            arrays += [pa.concat_arrays([pa.nulls(n, x.type), x]) for x in more]
        else:
            arrays += [pa.nulls(n, f.type) for f in fields[9:]]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

    def looked_up(sel, texts, ids, ties, zs, marks, docs, wins):
        """The documents numbered sel, which have marks, all at once."""
        off = np.concatenate(([0], np.cumsum([len(texts[r]) for r in sel])))
        data = np.frombuffer(b"".join([texts[r] for r in sel]), np.uint8)
        runs, at, bounds = spec.units(data, off)
        row, a, h, first, last = spec.groups(runs, at)
        own = marks.take(pa.array(sel))
        known = own.flatten().to_numpy().view(np.uint64)
        of = np.repeat(np.arange(len(sel)), np.diff(own.offsets.to_numpy()))
        place = lambda h, row: (h >> np.uint64(3)) ^ mix(row.astype(np.uint64) + np.uint64(1))
        keys, where = np.unique(place(known, of), return_inverse=True)
        bits = np.zeros(len(keys), np.int64)
        np.bitwise_or.at(bits, where, (known & np.uint64(7)).astype(np.int64))
        k = np.minimum(np.searchsorted(keys, place(h, row)), len(keys) - 1)
        got = np.where(keys[k] == place(h, row), bits[k], 0)
        full, ask = np.flatnonzero(got & REPEATS), np.flatnonzero(got & (UNCLEAR | SOURCE))
        mask = covered(int(at[-1]), first[full], last[full] + spec.window)
        judged, doc, tie = np.zeros(len(sel), bool), np.array([ids[r] for r in sel]), np.array([ties[r] for r in sel])
        if len(ask):
            many = last[ask] - first[ask] + 1
            to = np.concatenate(([0], np.cumsum(many)))
            start = np.arange(to[-1]) + np.repeat(first[ask] - to[:-1], many)
            unclear = (got[ask] & UNCLEAR) > 0
            judged[row[ask][unclear]] = True
            ws = pa.Array.from_buffers(pa.binary(), len(ask), [None, pa.py_buffer((8 * to).astype(np.int32)), pa.py_buffer(runs.of(start, start + spec.window))])
            wins.append((doc[row[ask]], tie[row[ask]], a[ask].view(np.int64), (first[ask] - at[row[ask]]) | np.where(unclear, _JUDGED, 0), ws))
        for i, r in enumerate(sel if asked else ()):
            gone, n = mask[at[i] : at[i + 1]], int(at[i + 1] - at[i])
            if judged[i]:
                docs.append((ids[r], n, None, None, None, None, ties[r], zs[r], np.column_stack(intervals(gone)).ravel().tolist()))
            else:
                words_ = bounds and tuple(x[at[i] : at[i + 1]] - off[i] for x in bounds)
                docs.append((ids[r], *_row(spec, texts[r], n, words_, gone, text), ties[r], None, None))
        return 8 * int(to[-1]) if len(ask) else 0

    def run(batches):
        for b in batches:
            ids, ties, zs, marks = *(b.column(c).to_pylist() for c in ("doc_id", "tie", "z")), b.column("marks")
            texts = decompressed(b.column("z"))
            has = marks.is_valid().to_pylist()
            docs, wins, size = [], [], 0
            for i, j in chunks(np.concatenate(([0], np.cumsum([len(x) for x in texts])))):
                if sel := [r for r in range(i, j) if has[r]]:
                    size += looked_up(sel, texts, ids, ties, zs, marks, docs, wins)
                for r in range(i, j) if asked else ():
                    if not has[r]:
                        docs.append((ids[r], *_whole(spec, texts[r], text), ties[r], None, None))
                size += sum(len(z) for z in zs[i:j])
                if size > 8 << 20:
                    yield table(docs, wins)
                    docs, wins, size = [], [], 0
            yield table(docs, wins)

    return run


def _finisher(spec: Repeats, text: bool, arrow_schema):
    def run(batches):
        for b in batches:
            docs = []
            for doc, tie, raw, removed, starts in zip(b.column("doc_id").to_pylist(), b.column("tie").to_pylist(), decompressed(b.column("z")), b.column("removed").to_pylist(), b.column("starts").to_pylist(), strict=True):
                data, bounds, n = np.frombuffer(raw, np.uint8), None, len(raw)
                if spec.unit == "word":
                    start, end, _ = words(data, np.array([0, len(raw)]), ~SPACE)
                    bounds, n = (start, end), len(start)
                own, more = np.array(removed or [], np.int64).reshape(-1, 2), np.array(starts or [], np.int64)
                mask = covered(n, np.concatenate((own[:, 0], more)), np.concatenate((own[:, 1], more + spec.window)))
                docs.append((doc, *_row(spec, raw, n, bounds, mask, text), tie))
            cols = list(zip(*docs, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow_schema, strict=True)], schema=arrow_schema)

    return run


_DECIDED = "doc_id long, tie long, starts array<long>, a long, ref long, ws binary"


def _decider(spec: Repeats, compared: int, held: int, arrow_schema):
    """Rows (doc_id, tie, a, ref, ws) in the order of a: the starts of judged windows that repeat, or the row itself if its anchor has too many."""

    def rows(t, decided=None):
        keep, starts = decided if decided else (np.arange(len(t)), None)
        t = t.take(pa.array(keep))
        if decided:
            more = [starts, *[pa.nulls(len(t), f.type) for f in list(arrow_schema)[3:]]]
        else:
            more = [pa.nulls(len(t), arrow_schema.field("starts").type), *[t.column(c).combine_chunks() for c in ("a", "ref", "ws")]]
        return pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("tie").combine_chunks(), *more], schema=arrow_schema)

    def decide(t):
        off, w = _unpacked(t.column("ws").combine_chunks())
        many = np.diff(off)
        row = np.repeat(np.arange(len(t)), many)
        doc, ref = (t.column(c).to_numpy() for c in ("doc_id", "ref"))
        a = t.column("a").to_numpy()[row]
        o = np.lexsort((w, a))
        new = np.ones(len(o), bool)
        new[1:] = (a[o][1:] != a[o][:-1]) | (w[o][1:] != w[o][:-1])
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        again = np.empty(len(o), bool)
        again[o] = np.minimum.reduceat(doc[row][o], at)[group] < doc[row][o] if spec.first_stays else np.diff(at, append=len(o))[group] > 1
        hit = np.flatnonzero(again & (ref[row] >= _JUDGED))
        count = np.bincount(row[hit], minlength=len(t))
        keep = np.flatnonzero(count)
        starts = (ref[row[hit]] & (_JUDGED - 1)) + hit - off[row[hit]]
        return rows(t, (keep, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count[keep]))), pa.int32()), pa.array(starts))))

    def run(batches):
        have, size, hot = [], 0, None
        for b in batches:
            t = pa.Table.from_batches([b])
            if hot is not None:
                n = int(np.searchsorted(t.column("a").to_numpy(), hot, "right"))
                if n:
                    yield rows(t.slice(0, n))
                    t = t.slice(n)
                if len(t):
                    hot = None
            if not len(t):
                continue
            have.append(t)
            size += t.column("ws").nbytes // 8
            if size >= compared:
                t = pa.concat_tables(have)
                a = t.column("a").to_numpy()
                n = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
                if n:
                    yield decide(t.slice(0, n))
                t = t.slice(n)
                have, size = [t], t.column("ws").nbytes // 8
                if size >= held:
                    yield rows(t)
                    have, size, hot = [], 0, a[-1]
        if have:
            yield decide(pa.concat_tables(have))

    return run


def _unpacked(ws: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n + 1 offsets of each row's windows, and their hashes."""
    data, off = utf8(ws)
    return (off - off[0]) // 8, data[off[0] : off[-1]].view(np.int64)


def _each_window(batches):
    for b in batches:
        off, w = _unpacked(b.column("ws"))
        row = np.repeat(np.arange(len(b)), np.diff(off))
        ref = b.column("ref").to_numpy()[row]
        start = (ref & (_JUDGED - 1)) + np.arange(len(w)) - off[row]
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(row)) for c in ("doc_id", "tie", "a")], pa.array(w), pa.array(start), pa.array(ref >= _JUDGED)], ["doc_id", "tie", "a", "w", "start", "judged"])


def _repeated_windows(wins: DataFrame, spec: Repeats, stage) -> DataFrame:
    """key and starts of the judged windows that repeat."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    decider = _decider(spec, COMPARED, HELD, to_arrow_schema(StructType.fromDDL(_DECIDED)))
    some = stage(wins.select("doc_id", "tie", "a", "ref", "ws").repartition("a").sortWithinPartitions("a").mapInArrow(decider, _DECIDED), "decided")
    starts = some.where("starts IS NOT NULL").select(*spec.key, "starts")
    open_ = some.where("ws IS NOT NULL")
    if not open_.isEmpty():
        each = open_.select("doc_id", "tie", "a", "ref", "ws").mapInArrow(_each_window, "doc_id long, tie long, a long, w long, start long, judged boolean")
        by_w = Window.partitionBy("a", "w")
        again = F.min("doc_id").over(by_w) < F.col("doc_id") if spec.first_stays else F.count(F.lit(1)).over(by_w) > 1
        starts = starts.unionByName(each.withColumn("again", again).where("judged AND again").select(*spec.key, F.array("start").alias("starts")))
    return starts.groupBy(*spec.key).agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def _resolved(own: DataFrame, marks: DataFrame, key: list[str], spec: Repeats, text: bool, asked: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"{_DOC}, {_WINDOWS}"
    rows = compressed(own, "tie").drop("n_bytes").join(marks, key, "left" if asked else "inner").select("doc_id", "tie", "z", "marks")
    return rows.mapInArrow(_resolver(spec, text, to_arrow_schema(StructType.fromDDL(schema)), asked), schema)


def without_repeats(all_rows: DataFrame, own: DataFrame, again: DataFrame | None, marks: DataFrame, others: tuple | None, spec: Repeats, text: bool, stage) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 and (with text) kept of each of the tied rows `all_rows`, by the marks of `own`; see once().

    others: tied rows of history, the marks of those to resolve again, and the marks' key. stage(df, name) stores and rereads.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    seen = stage(_resolved(own, _collected(marks, spec.key), spec.key, spec, text, True), "resolved")
    wins = seen.where("ws IS NOT NULL").select("doc_id", "tie", "a", "ref", "ws")
    if others is not None:
        wins = wins.unionByName(_sources(*others, spec, stage))
    starts = _repeated_windows(wins, spec, stage)
    wanted = seen.where("z IS NOT NULL").select("doc_id", "tie", "z", "removed").join(starts, spec.key, "left")
    done = wanted.mapInArrow(_finisher(spec, text, to_arrow_schema(StructType.fromDDL(RESULT))), RESULT)
    names = [x.split()[0] for x in RESULT.split(", ")]
    out = seen.where("n_removed IS NOT NULL").select(*names).unionByName(done)
    if again is not None:
        out = stage(out, "one")
        keys = F.broadcast(again) if again.limit(SHARED + 1).count() <= SHARED else again
        shared = out.join(keys, KEY, "left_semi")
        if not spec.first_stays:  # each window of such a row starts in its copies, too
            whole = F.col("n_units") >= spec.window
            gone = {"n_removed": F.col("n_units"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "kept": F.lit("" if text else None).cast("string")}
            shared = shared.withColumns({c: F.when(whole, v).otherwise(F.col(c)) for c, v in gone.items()})
        shared = stage(shared, "shared")
        out = out.join(keys, KEY, "left_anti").unionByName(all_rows.select(*KEY).join(shared, KEY).select(*names))
    return out.select(real_id(), *names[1:-1])


def sought(marks: DataFrame, key: list[str], history: DataFrame, stage) -> tuple[DataFrame, DataFrame]:
    """The rows of history that must be resolved again (all of them if these are many: the join with the marks picks them), and their marks."""
    marks = stage(_collected(marks, key), "sought")
    keys = marks.select(*key)
    return (history.join(F.broadcast(keys), key, "left_semi") if keys.limit(SHARED + 1).count() <= SHARED else history), marks


def _sources(history: DataFrame, marks: DataFrame, key: list[str], spec: Repeats, stage) -> DataFrame:
    rows, marks = sought(marks, key, once(history, stage)[0], stage)
    wins = _resolved(rows, marks, key, spec, False, False).where("ws IS NOT NULL")
    doc_id = F.lit(-(1 << 63)).alias("doc_id") if spec.first_stays else F.col("doc_id")  # before all of the batch
    return wins.select(doc_id, F.lit(0).cast("long").alias("tie"), "a", F.lit(0).cast("long").alias("ref"), "ws")
