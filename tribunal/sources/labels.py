"""Label, verdict and report files (JSON lines and JSON), validated by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timestamps import is_timestamp
from ..functions.verdicts import CATEGORIES, stripped


class BadRecord(ValueError):
    """A line that isn't what it should be: names the line and the field."""


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and value of each line that isn't blank, by file.

    Files are read in blocks; the lines of each block are numbered by themselves, after the counts of the blocks before it in its file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__nth"), "value")
    counts = lines.groupBy("file", "__block").count()  # a row per block
    earlier = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("file", "__block").orderBy("__nth"))
    rows = lines.withColumn("__own", own).join(before, ["file", "__block"])
    return rows.select("file", (F.col("__before") + F.col("__own")).alias("line_no"), "value").where(stripped(F.col("value")) != "")


def checked_labels(lines: DataFrame) -> DataFrame:
    """line_no, the label fields, and error: the first field that is wrong, or null.

    Absent, null and wrongly typed values differ in JSON, so fields are read as variants: confidence must be a whole number, not 1.0, true or null.
    """
    v = lines.withColumn("v", F.expr("try_parse_json(value)"))
    text = lambda f: F.expr(f"CASE WHEN schema_of_variant(variant_get(v, '$.{f}')) = 'STRING' THEN variant_get(v, '$.{f}', 'string') END")
    v = v.withColumns({f: text(f) for f in ("item_id", "label", "labeler_id", "timestamp", "probe")})
    there = lambda f: F.expr(f"variant_get(v, '$.{f}') IS NOT NULL")
    whole = F.expr("schema_of_variant(variant_get(v, '$.confidence')) = 'BIGINT'")
    v = v.withColumn("confidence", F.when(~there("confidence"), F.lit(2)).when(whole, F.expr("try_variant_get(v, '$.confidence', 'int')")))
    filled = lambda f: F.coalesce(stripped(F.col(f)) != "", F.lit(False))
    error = (
        F.when(F.col("v").isNull() | ~F.expr("schema_of_variant(v) LIKE 'OBJECT%'"), "record")
        .when(~filled("item_id"), "item_id")
        .when(~F.coalesce(F.col("label").isin(*CATEGORIES), F.lit(False)), "label")
        .when(~filled("labeler_id"), "labeler_id")
        .when(~is_timestamp(F.col("timestamp")), "timestamp")
        .when(there("probe") & ~filled("probe"), "probe")
        .when(~F.coalesce(F.col("confidence").between(1, 3), F.lit(False)), "confidence")
    )
    return v.select("file", "line_no", "item_id", "label", "labeler_id", "timestamp", "probe", "confidence", error.alias("error"))


def read_labels(spark: SparkSession, path) -> DataFrame:
    """Labels of one file or several (appended); the first bad line raises."""
    out = None
    for p in [path] if isinstance(path, str) else path:
        rows = checked_labels(numbered_lines(spark, p))
        if (bad := rows.where("error IS NOT NULL").orderBy("line_no").first()) is not None:
            raise BadRecord(f"{p}, line {bad.line_no}: {bad.error}")
        out = rows if out is None else out.unionByName(rows)
    return out.drop("error", "file")


VERDICT = "struct<item_id: string, verdict: string>"
REPORT = f"judge_id string, adapter string, grade string, generated_at string, probes array<struct<probe: string, version: string, n_items: long, n_valid: long, events: long, rate: double, p_value: double, alpha: double, min_n: long, seed: long, verdicts: array<{VERDICT}>>>"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """judge, probe, item_id and verdict of a run report; the last of equal items holds."""
    report = spark.read.schema(REPORT).json(path, multiLine=True)
    probes = report.select(F.coalesce("judge_id", "adapter").alias("judge"), F.explode("probes").alias("p"))
    if not probes.where("p.verdicts IS NULL").isEmpty():
        raise BadRecord(f"{path}: a probe has no verdicts")
    rows = probes.select("judge", "p.probe", F.posexplode("p.verdicts").alias("pos", "v"))
    return rows.groupBy("judge", "probe", "v.item_id").agg(F.max_by("v.verdict", "pos").alias("verdict"))


def read_replay(spark: SparkSession, blinded: str, verdicts: str) -> DataFrame:
    """id, system, user and verdict of a recorded session; prompts must differ, and each id needs a verdict."""
    prompts, replies = (numbered_lines(spark, p) for p in (blinded, verdicts))
    field = lambda f: F.get_json_object("value", f"$.{f}").alias(f)
    for rows, path in ((prompts, blinded), (replies, verdicts)):
        if (bad := rows.where(F.expr("try_parse_json(value) IS NULL")).select(F.min("line_no")).first()[0]) is not None:
            raise BadRecord(f"{path}, line {bad}: not JSON")
    prompts = prompts.select("line_no", *[field(f) for f in ("id", "system", "user")])
    replies = replies.select("line_no", *[field(f) for f in ("id", "verdict")])
    for rows, names, path in ((prompts, ("id", "system", "user"), blinded), (replies, ("id", "verdict"), verdicts)):
        if (bad := rows.where(" OR ".join(f"{f} IS NULL" for f in names)).select(F.min("line_no")).first()[0]) is not None:
            raise BadRecord(f"{path}, line {bad}: a field is missing")
    return replayed(prompts.drop("line_no"), replies.drop("line_no"))


def replayed(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    key = F.sha2(F.concat_ws("\0", "system", "user"), 256)
    if not prompts.groupBy(key.alias("k")).count().where("count > 1").isEmpty():
        raise BadRecord("a prompt comes more than once")
    if (bad := prompts.join(replies, "id", "left_anti").select(F.min("id")).first()[0]) is not None:
        raise BadRecord(f"no verdict for {bad!r}")
    return prompts.join(replies, "id").withColumn("prompt_key", key)
