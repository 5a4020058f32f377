"""Secret scan: all rules in one automaton, one pass over the bytes of each text.

Only texts in which some rule accepts are looked at further: there the leftmost start comes from a pass of the reversed rule, the longest end from the
rule itself, and shorter matches than the rule allows are dropped after they were consumed. No shuffle.

Null text: empty, no spans. Repeated rows each get their row; columns other than doc_id and text don't matter, and `redact` keeps them.
"""

from __future__ import annotations


from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import compile_rules, parse, reverse, scan, shortest
from .common import chunks, lean, table, utf8


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: characters of the match; tail: characters, from the first at which the rule accepts."""

    kind: str
    pattern: str
    least: int = 0
    tail: int = 0


#: Characters of an assigned value.
VALUE = "[A-Za-z0-9+/_.=-]"
BASE = (
    Rule("assign", f"""(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?{VALUE}+""", tail=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),  # the same runs as [0-9a-f]+ of 24 characters or more; this form is quiet on prose
)
#: Publicly documented shapes of credentials.
MORE = (
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[opsru]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", least=40),
)


class Scanner:
    def __init__(self, rules=BASE + MORE):
        self.rules = rules
        parsed = [parse(r.pattern) for r in rules]
        first = [shortest(p) for p in parsed]  # finding a match needs no more than its shortest form, which keeps the automaton small
        self.all = compile_rules(first, True)
        self.each = [compile_rules([p], False) for p in parsed]
        self.back = [compile_rules([reverse(p)], False) for p in first]

    def _walk(self, a, raw: bytes, at: int, stop: int, step: int) -> int | None:
        """The farthest accepting place from `at`, over raw[at:stop] forward or raw[stop:at] backward."""
        state, far, to, cls = 0, None, a.next, a.class_of
        while at != stop:
            state = to[state * a.classes + cls[raw[at if step > 0 else at - 1]]]
            if state == a.dead:
                break
            at += step
            if a.accepts[state]:
                far = at
        return far

    def matches(self, raw: bytes, ends: np.ndarray, states: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, from the accepting steps of one text."""
        marks = np.array([self.all.accepts[s] for s in states.tolist()])
        out = []
        for k, rule in enumerate(self.rules):
            events, bound, i = ends[(marks >> k) & 1 == 1].tolist(), 0, 0
            while i < len(events):
                start = self._walk(self.back[k], raw, events[i], bound, -1)
                if start is None:  # it began in what an earlier match consumed
                    i += 1
                    continue
                end = self._walk(self.each[k], raw, start, len(raw), 1)
                if end - start >= rule.least and not (rule.tail and self._short(k, raw, start, end)):
                    out.append((start, k, end))
                bound = end
                i = bisect_right(events, end)
        return sorted(out)

    def _short(self, k: int, raw: bytes, start: int, end: int) -> bool:
        """Whether the value of an assignment is too short: it begins where the rule first accepts."""
        a, state, at = self.each[k], 0, start
        while not a.accepts[state]:
            state = a.next[state * a.classes + a.class_of[raw[at]]]
            at += 1
        return end - (at - 1) < self.rules[k].tail

    def rows(self, data: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
        row, end, state = scan(self.all, data, off)
        for r in np.unique(row).tolist():
            i, j = np.searchsorted(row, [r, r + 1])
            out[r] = self.matches(bytes(data[off[r] : off[r + 1]]), end[i:j], state[i:j])
        return out


SPANS = "array<struct<kind: string, start: long, end: long>>"


def find_secrets(docs: DataFrame, rules=BASE + MORE) -> DataFrame:
    """doc_id and spans (code points, end exclusive; by start, then the rules' order) of each row."""
    kinds = [r.kind for r in rules]

    def run(batches):
        scanner = Scanner(rules)
        for b in batches:
            data, off = utf8(b.column("text"))
            spans = []
            for i, j in chunks(off, 8 << 20):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                for r, found in enumerate(scanner.rows(part, o)):
                    if found:  # bytes to code points
                        before = np.concatenate(([0], np.cumsum((part[o[r] : o[r + 1]] & 0xC0) != 0x80)))
                        found = [{"kind": kinds[k], "start": int(before[s]), "end": int(before[e])} for s, k, e in found]
                    spans.append(found)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, rules=BASE + MORE, by: str = "[secret]") -> DataFrame:
    """docs with each span of its text replaced; overlapping spans count as one. All columns stay."""
    at = docs.columns.index("text")

    def run(batches):
        scanner = Scanner(rules)
        for b in batches:
            column = b.column(at)
            data, off = utf8(column)
            changed = {}
            for i, j in chunks(off, 8 << 20):
                for r, found in enumerate(scanner.rows(data[off[i] : off[j]], off[i : j + 1] - off[i]), i):
                    if found:
                        raw, out, last = bytes(data[off[r] : off[r + 1]]), [], 0
                        for s, _, e in found:
                            if s >= last:
                                out += [raw[last:s], by.encode()]
                            last = max(last, e)
                        changed[r] = b"".join([*out, raw[last:]]).decode("utf-8", "replace")
            if changed:
                texts = column.to_pylist()
                for r, x in changed.items():
                    texts[r] = x
                columns = b.columns
                columns[at] = pa.array(texts, column.type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(lean(run), docs.schema)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql_kind(number: int, rule: Rule) -> str:
    """Matches of one rule with their starts: what stands between matches, and the matches before, add up to them."""
    pattern = rule.pattern.replace(f"{VALUE}+", f"({VALUE}+)") if rule.tail else rule.pattern
    pattern = pattern.replace("'", "''")
    kept = [f"length(x) >= {rule.least}"] if rule.least else []
    kept += [f"length(regexp_extract(x, '{pattern}', 1)) >= {rule.tail}"] if rule.tail else []
    return f"""SELECT rid, {number} AS nth, '{rule.kind}' AS kind, start, start + length(x) AS stop FROM (
    SELECT rid, m[i] AS x, list_sum(list_transform(s[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS start
    FROM (SELECT rid, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS s FROM d WHERE regexp_matches(t, '{pattern}')))
    ) WHERE {' AND '.join(kept) or 'true'}"""


SQL_OP7 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_sql_kind(k, r) for k, r in enumerate(BASE + MORE))}),
g AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
    string_agg(concat_ws(':', kind, CAST(start AS BIGINT), CAST(stop AS BIGINT)), ',' ORDER BY start, nth) FILTER (nth < {len(BASE)}) AS base, string_agg(concat_ws(':', kind, CAST(start AS BIGINT), CAST(stop AS BIGINT)), ',' ORDER BY start, nth) AS spans
    FROM f GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""

QUERIES = {"op7_secret_scan": op7_secret_scan}
SQL = {"op7_secret_scan": SQL_OP7}
