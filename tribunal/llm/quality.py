"""Quality rules: a threshold table compiled into one projection of built-in expressions (no user functions).

Signals are counted once per text; each rule compares two integers, so that verdicts don't hang on rounding. Windows of three words are compared by
their 64-bit hash within one text. No shuffle.

Null text: no words, so it fails. Repeated rows each get their row. Columns of the input stay in `keep_good`; the names of this module's own columns
all start with `__q_`. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: White space of the word rule, and symbol characters.
BLANKS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = sorted(set((
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au dans de des du elle en est et il la le les ou par pour que qui sur un une "
    "auf das der die ein eine für ist mit nicht und von zu "
    "con del el es las los no para por se y"
).split()))


@dataclass(frozen=True)
class Threshold:
    """A text fails if times * signal > most * per (or < least * per); per names a signal, or "one"."""

    name: str
    signal: str
    per: str
    times: int = 100
    least: int | None = None
    most: int | None = None


BASE = (
    Threshold("too_short", "n_words", "one", 1, least=50),
    Threshold("repeats_itself", "n_repeat_words", "n_words", 100, most=50),
)
#: Beyond the base rules: word length, symbols, capitals, stop words and lines.
MORE = (
    Threshold("too_long", "n_words", "one", 1, most=1_000_000),
    Threshold("short_words", "word_chars", "n_words", 100, least=250),
    Threshold("long_words", "word_chars", "n_words", 100, most=1200),
    Threshold("symbols", "n_symbols", "n_words", 100, most=10),
    Threshold("capitals", "n_capitals", "word_chars", 100, most=40),
    Threshold("few_stop_words", "n_stop_words", "n_words", 100, least=5),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", 100, most=50),
)
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_signals(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """docs with the column __q_<signal> (long) for each of SIGNALS."""
    c = lambda name: F.col("__q_" + name)
    long = lambda x: x.cast("long")
    df = docs.withColumn("__q_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumns({
        "__q_list": F.filter(F.split("__q_text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""),
        "__q_full": F.filter(F.split("__q_text", "\n"), lambda x: F.translate(x, BLANKS, "") != ""),
    })
    df = df.withColumns({
        "__q_n_words": long(F.size("__q_list")),
        "__q_word_chars": long(_without(c("text"), BLANKS)),
        "__q_n_symbols": long(F.length("__q_text") - _without(c("text"), SYMBOLS)),
        "__q_n_capitals": long(F.length("__q_text") - _without(c("text"), CAPITALS)),
        "__q_n_stop_words": long(F.size(F.filter("__q_list", lambda w: F.lower(F.rtrim(w, F.lit(".,"))).isin(stop_words)))),
        "__q_n_lines": long(F.size("__q_full")),
        "__q_n_dup_lines": long(F.size("__q_full") - F.size(F.array_distinct("__q_full"))),
        "__q_sorted": F.when(F.size("__q_list") >= 3, F.sort_array(F.transform(
            F.slice("__q_list", 1, F.size("__q_list") - 2),
            lambda w, i: F.struct(F.xxhash64(w, F.get(c("list"), i + 1), F.get(c("list"), i + 2)).alias("h"), i.alias("p")),
        ))),
    })
    same = lambda x, i: F.get(c("sorted"), i)["h"] == x["h"]
    twice = F.filter("__q_sorted", lambda x, i: F.coalesce(same(x, i + 1), F.lit(False)) | F.coalesce(same(x, i - 1), F.lit(False)))
    df = df.withColumn("__q_twice", F.sort_array(F.transform(twice, lambda x: x["p"])))
    shares = F.transform("__q_twice", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(c("twice"), i + 1) - p, F.lit(3))))
    df = df.withColumn("__q_n_repeat_words", long(F.coalesce(F.aggregate(shares, F.lit(0), lambda a, x: a + x), F.lit(0))))
    return df.drop("__q_text", "__q_list", "__q_full", "__q_sorted", "__q_twice")


def fails(rules) -> Column:
    """One condition for a table of rules, over the signals' columns."""
    out = F.lit(False)
    for r in rules:
        x, per = F.col(f"__q_{r.signal}") * r.times, F.lit(1) if r.per == "one" else F.col(f"__q_{r.per}")
        out = out | ((x < r.least * per) if r.least is not None else F.lit(False)) | ((x > r.most * per) if r.most is not None else F.lit(False))
    return out


def keep_good(docs: DataFrame, rules=BASE + MORE) -> DataFrame:
    """The rows of docs that no rule rejects."""
    # the row number keeps the optimizer from moving the condition below the signals, where it would count each of them many times over
    rows = with_signals(docs).select("*", fails(rules).alias("__q_bad"), F.monotonically_increasing_id().alias("__q_row"))
    return rows.where("NOT __q_bad AND __q_row >= 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = with_signals(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *[F.col("__q_" + s).alias(s) for s in shown], fails(BASE).alias("base_failed"), (~fails(BASE + MORE)).alias("kept"))


def _sql_fails(rules) -> str:
    parts = []
    for r in rules:
        per = "1" if r.per == "one" else r.per
        parts += [f"{r.times} * {r.signal} < {r.least} * {per}"] if r.least is not None else []
        parts += [f"{r.times} * {r.signal} > {r.most} * {per}"] if r.most is not None else []
    return "(" + " OR ".join(parts) + ")"


def signals_sql(source: str) -> str:
    """CTEs (without WITH) that end in `signals`: the rows of `source` with a row number rid and all signals."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
numbered AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS body FROM {source}),
listed AS (SELECT rid, list_filter(regexp_split_to_array(body, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS full_lines FROM numbered),
triples AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
    FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM listed)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM triples) WHERE n > 1),
repeated AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
signals AS (SELECT numbered.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(body) - length(translate(body, '{CAPITALS}', '')) AS BIGINT) AS n_capitals,
    CAST(len(list_filter(words, lambda w: lower(rtrim(w, '.,')) IN ({stop}))) AS BIGINT) AS n_stop_words,
    CAST(len(full_lines) AS BIGINT) AS n_lines, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM numbered JOIN listed USING (rid) LEFT JOIN repeated USING (rid))"""


SQL_OP6 = f"""WITH {signals_sql("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_sql_fails(BASE)} AS base_failed, NOT {_sql_fails(BASE + MORE)} AS kept FROM signals"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL = {"op6_quality_rules": SQL_OP6}
