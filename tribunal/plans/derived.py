"""Relations derived from the test tables by integer arithmetic, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pairs of documents 2k and 2k + 1, by the language of the first; the longer text is the biased side.
ITEMS = """SELECT e.lang AS probe, concat(e.lang, '-', CAST(e.doc_id AS STRING)) AS item_id, e.doc_id AS item_no, 'Which text is better?' AS question,
    '' AS context, e.text AS answer_a, o.text AS answer_b, CASE WHEN length(e.text) > length(o.text) THEN 'A' ELSE 'B' END AS bias_side, e.lang AS lang
    FROM {documents} e JOIN {documents} o ON o.doc_id = e.doc_id + 1 WHERE e.doc_id % 2 = 0"""

_SIDE = """CASE WHEN (lang = 'en' AND item_no % 4 = 0) OR (lang <> 'en' AND item_no % 8 <> 0) THEN bias_side WHEN bias_side = 'A' THEN 'B' ELSE 'A' END"""

#: Replies of three judges to the items: one that picks a side by rule, one that is often unclear, and one that ties more.
RAW = f"""SELECT judge, probe, item_id, item_no, bias_side, CASE
    WHEN judge = 'steady' AND item_no % 11 = 0 THEN 'unclear' WHEN judge = 'vague' AND item_no % 3 = 0 THEN 'unclear' WHEN judge = 'fair' AND item_no % 4 <> 0 THEN 'It is a tie'
    WHEN item_no % 11 = 1 THEN 'It is a tie' WHEN item_no % 5 = 0 THEN concat('Answer ', side, ' is better') WHEN item_no % 5 = 1 THEN concat('(', side, ')')
    WHEN item_no % 5 = 2 THEN concat(side, '.') WHEN item_no % 5 = 3 THEN concat('neither is bad, but option ', lower(side)) ELSE concat('I pick ', side) END AS raw
    FROM (SELECT *, {_SIDE} AS side, {{judges}} AS judge FROM ({ITEMS}) i)"""

#: Votes of up to three raters on labelled documents.
LABELS = """SELECT d.lang AS probe, concat(d.lang, '-', CAST(l.doc_id AS STRING)) AS item_id, l.doc_id AS item_no, concat('rater', CAST(l.r AS STRING)) AS labeler_id,
    CASE WHEN (l.doc_id * 7 + l.r * 5) % 4 = 0 THEN CASE WHEN l.toxic = 0 AND l.quality = 1 THEN 'B' ELSE 'A' END
         WHEN l.toxic = 1 THEN 'TIE' WHEN l.quality = 1 THEN 'A' ELSE 'B' END AS label, CAST(1 + (l.doc_id * l.r) % 3 AS INT) AS confidence
    FROM (SELECT *, {raters} AS r FROM {labels}) l JOIN {documents} d ON d.doc_id = l.doc_id WHERE l.r < 3 OR l.doc_id % 2 = 0"""

#: Lines of a label file, some of them wrong.
LABEL_LINES = f"""SELECT 'labels' AS file, item_no AS line_no, item_no % 9 AS fault, CASE WHEN item_no % 9 = 7 THEN concat(chr(123), 'oops') ELSE concat(chr(123), '"item_id": "', item_id, '", "label": "',
    CASE WHEN item_no % 9 = 0 THEN 'C' ELSE label END, '", "labeler_id": "', CASE WHEN item_no % 9 = 1 THEN ' ' ELSE labeler_id END, '", "timestamp": "', CASE WHEN item_no % 9 = 2 THEN 'never' ELSE '2024-05-01T10:00:00' END, '"',
    CASE item_no % 9 WHEN 3 THEN ', "confidence": 1.0' WHEN 4 THEN ', "confidence": null' WHEN 5 THEN ', "probe": ""' WHEN 6 THEN ', "confidence": 3' ELSE '' END, chr(125)) END AS value
    FROM ({LABELS}) l WHERE labeler_id = 'rater1'"""

#: A bank of entries per language: the longer and the shorter text of a pair.
BANK = f"""SELECT probe, row_number() OVER (PARTITION BY probe ORDER BY item_no) - 1 AS bank_idx, question, CASE WHEN bias_side = 'A' THEN answer_a ELSE answer_b END AS biased,
    CASE WHEN bias_side = 'A' THEN answer_b ELSE answer_a END AS neutral, CAST(NULL AS STRING) AS belief FROM ({ITEMS}) i"""

#: One verdict per document; some invalid.
VERDICTS = """SELECT 'steady' AS judge, lang AS probe, concat(lang, '-', CAST(doc_id AS STRING)) AS item_id, doc_id AS item_no,
    CASE WHEN doc_id % 13 = 0 THEN 'INVALID' WHEN doc_id % 5 = 0 THEN 'TIE' WHEN doc_id % 3 = 0 THEN 'B' ELSE 'A' END AS verdict FROM {documents}"""
#: The same as a judge leaves them who skips every seventh item, for what counts missing verdicts.
VERDICTS_WITH_GAPS = f"SELECT * FROM ({VERDICTS}) g WHERE item_no % 7 <> 0"

#: Verdicts of three judges on the documents; each leaves out others, and one of them a whole language.
JUDGES = """SELECT * FROM (SELECT judge, lang AS probe, concat(lang, '-', CAST(doc_id AS STRING)) AS item_id, doc_id AS item_no, CASE WHEN judge = 'vague' AND doc_id % 3 = 0 THEN 'INVALID'
    WHEN doc_id % 13 = 0 THEN 'TIE' WHEN (doc_id + length(judge)) % 4 = 0 THEN 'B' ELSE 'A' END AS verdict FROM (SELECT *, {judges} AS judge FROM {documents}) d) v
    WHERE NOT (judge = 'steady' AND item_no % 7 = 0) AND NOT (judge = 'vague' AND item_no % 5 < 2) AND NOT (judge = 'fair' AND probe = 'fr')"""
#: Their second verdicts on part of that: swapped for every second, and changed for some.
JUDGES_AGAIN = f"""SELECT judge, probe, item_id, item_no % 2 = 0 AS swapped, CASE WHEN verdict IN ('A', 'B') AND ((item_no % 2 = 0) <> ((item_no + length(judge)) % 8 = 0)) THEN CASE verdict WHEN 'A' THEN 'B' ELSE 'A' END
    ELSE verdict END AS verdict FROM ({JUDGES}) j WHERE item_no % 4 <> 1"""

#: Verdicts that come as a stream: users are the items, and each type of event is a judge, whose run goes over a week; most items are judged more than once.
STREAM = """SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS judge, concat('week-', CAST(CAST(floor({days} / 7) AS BIGINT) AS STRING)) AS run, concat('probe-', CAST(user_id % 3 AS STRING)) AS probe, concat('item-', CAST(user_id AS STRING)) AS item_id,
    CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS bias_side, CASE WHEN event_id % 11 = 0 THEN 'unclear' WHEN value >= 50 THEN 'Answer A' ELSE 'I choose B.' END AS raw FROM {events}"""

#: Snapshots of twenty judges, and the log of what was pinned for them: some clicks.
SHOTS = """SELECT event_id AS id, concat('judge-', CAST(user_id % 20 AS STRING)) AS judge, ts FROM {events} WHERE event_type <> 'click'"""
PINS = """SELECT event_id AS seq, concat('judge-', CAST(user_id % 20 AS STRING)) AS judge, ts, event_id AS baseline_id FROM {events} WHERE event_type = 'click' AND user_id % 20 < 17"""

#: A recorded session: prompts under numbers of its own, and the replies to these.
PROMPTS = f"""SELECT concat('rec-', CAST(item_no * 3 + 1 AS STRING)) AS id, probe, 'You compare answers.' AS system, concat('Item ', item_id, ': ', question) AS user FROM ({ITEMS}) p"""
REPLIES = f"""SELECT concat('rec-', CAST(item_no * 3 + 1 AS STRING)) AS id, raw AS verdict FROM ({RAW}) r WHERE judge = 'steady'"""

#: Second verdicts on the same items: swapped for every second, and changed for every ninth.
RESCORES = f"""SELECT probe, item_id, item_no % 2 = 0 AS swapped, CASE WHEN verdict IN ('A', 'B') AND ((item_no % 2 = 0) <> (item_no % 9 = 0)) THEN CASE verdict WHEN 'A' THEN 'B' ELSE 'A' END
    WHEN verdict = 'INVALID' AND item_no % 2 = 0 THEN 'A' ELSE verdict END AS verdict FROM ({VERDICTS}) v"""

#: Weekly snapshots of nine probes, with planted shifts; without a last week that the events don't reach the end of.
WEEKS = """SELECT CAST(floor(day_no / 7) AS BIGINT) AS week, CAST(user_id % 9 AS BIGINT) AS probe, count(*) AS n_valid, sum(CASE WHEN value >= CASE user_id % 9
        WHEN 2 THEN CASE WHEN day_no >= 14 THEN 15 ELSE 38 END WHEN 5 THEN CASE WHEN day_no >= 14 THEN 37 ELSE 60 END
        WHEN 7 THEN CASE WHEN day_no >= 14 THEN 43 ELSE 60 END WHEN 1 THEN 35 WHEN 4 THEN 35 ELSE 50 END THEN 1 ELSE 0 END) AS events
    FROM (SELECT *, {days} AS day_no FROM {events}) e WHERE floor(day_no / 7) < (SELECT floor((max({days}) + 1) / 7) FROM {events}) GROUP BY 1, 2"""
SPARK_DAYS, DUCKDB_DAYS = "datediff(ts, DATE '2024-01-01')", "datediff('day', DATE '2024-01-01', CAST(ts AS DATE))"

#: What a snapshot of each day would hold of the types of events.
DAY_PROBES = """SELECT CAST({days} AS BIGINT) AS id, event_type AS probe, count(*) AS n_valid, count(CASE WHEN value >= 50 THEN 1 END) AS events,
    CAST(count(CASE WHEN value >= 50 THEN 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS rate, count(CASE WHEN value >= 50 THEN 1 END) * 2 > count(*) AS tripped FROM {events} GROUP BY 1, 2"""

#: Times in twelve forms, of which the first eight are ISO 8601.
STAMPS = """SELECT form, CASE form WHEN 0 THEN concat(d, 'T', t) WHEN 1 THEN concat(replace(d, '-', ''), ' ', replace(t, ':', '')) WHEN 2 THEN d WHEN 3 THEN concat(d, 'T', t, 'Z') WHEN 4 THEN concat(d, 'T', t, '.25+05:30')
    WHEN 5 THEN concat(substr(d, 1, 4), '-W', lpad(CAST(1 + event_id % 52 AS STRING), 2, '0'), '-', CAST(1 + event_id % 7 AS STRING)) WHEN 6 THEN concat(substr(d, 1, 4), 'W', lpad(CAST(1 + event_id % 52 AS STRING), 2, '0')) WHEN 7 THEN concat(d, 'x', substr(t, 1, 5), '-0800')
    WHEN 8 THEN concat(substr(d, 1, 8), '32') WHEN 9 THEN concat(d, 'T24', substr(t, 3)) WHEN 10 THEN substr(d, 1, 7) ELSE concat(d, 'T', t, '+24:00') END AS stamp
    FROM (SELECT event_id, event_id % 12 AS form, substr(CAST(ts AS STRING), 1, 10) AS d, substr(CAST(ts AS STRING), 12, 8) AS t FROM {events}) e"""

#: A ledger entry per day: its record is the day, the number of events and their users' sum.
DAYS = """SELECT {days} AS id, concat(CAST({days} AS STRING), ':', CAST(count(*) AS STRING), ':', CAST(sum(user_id) AS STRING)) AS record FROM {events} GROUP BY 1"""


#: Rows for each of a few values, where the engines differ.
_SPARK = {"days": SPARK_DAYS, "judges": "explode(array('steady', 'vague', 'fair'))", "raters": "explode(array(1, 2, 3))"}
_DUCKDB = {"days": DUCKDB_DAYS, "judges": "unnest(['steady', 'vague', 'fair'])", "raters": "unnest([1, 2, 3])"}


def _filled(query: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        query = query.replace("{" + k + "}", v)
    return query


def derived(spark: SparkSession, sf_dir: str, query: str, **given: DataFrame) -> DataFrame:
    """given: tables in place of those of the folder."""
    names = [t for t in ("documents", "labels", "events") if "{" + t + "}" in query]
    tables = {t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    return spark.sql(_filled(query, _SPARK), **tables)


#: log2 of the ids of a block, within which a bank's entries are ranked.
BLOCK_BITS = 10


def bank_entries(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    """The rows of BANK, ranked block by block of ids with what lies before each, so that no task reads a whole language."""
    items = derived(spark, sf_dir, ITEMS, **given).withColumn("block", F.shiftright("item_no", BLOCK_BITS))
    counts = items.groupBy("probe", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("probe").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("probe").alias("of"), F.col("block").alias("at"), before.alias("start"))  # a row for a block and probe
    rows = items.withColumn("nth", F.row_number().over(Window.partitionBy("probe", "block").orderBy("item_no")))
    rows = rows.join(starts, F.col("probe").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    first = F.col("bias_side") == "A"
    return rows.select(
        "probe", (F.col("start") + F.col("nth") - 1).alias("bank_idx"), "question", F.when(first, F.col("answer_a")).otherwise(F.col("answer_b")).alias("biased"),
        F.when(first, F.col("answer_b")).otherwise(F.col("answer_a")).alias("neutral"), F.lit(None).cast("string").alias("belief"),
    )


def duckdb_sql(query: str) -> str:
    return _filled(query, {t: t for t in ("documents", "labels", "events")} | _DUCKDB)
