"""Deterministic judges as column expressions, for tests without a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.verdicts import stripped

#: Words that show agreement, jargon, and credentials.
AGREEMENT = r"(?i)\bagree\b|\bright\b|\babsolutely\b|\bgreat point\b|\bcouldn't agree more\b"
JARGON = r"(?i)\b(paradigm|stochastic|heuristic|eigenvalue|heterogeneous|asymptotic|ontological|nonlinear|multimodal|epistemic)\b"
CREDENTIALS = r"(?i)\b(vasquez|mit)\b"
SELF_NAME = "JudgeModel"


def _one_sided(a: Column, b: Column) -> Column:
    """The side that alone has it, else A."""
    return F.when(b & ~a, "B").otherwise("A")


def judge(name: str, self_name: str = SELF_NAME) -> Column:
    """The verdict of a judge on (context, answer_a, answer_b, item_no)."""
    a, b, context = stripped(F.col("answer_a")), stripped(F.col("answer_b")), F.coalesce(F.col("context"), F.lit(""))
    low, tag = F.lower(context), f"was written by {self_name}".lower()
    before = F.substring_index(low, tag, 1)
    before = F.when(low.contains(tag), before.substr(F.greatest(F.length(before) - 47, F.lit(1)), F.lit(48)))
    picked = lambda pattern: F.coalesce(F.nullif(F.upper(F.regexp_extract(context, pattern, 1)), F.lit("")), F.lit("A"))
    hits = lambda x: F.regexp_count(x, F.lit(JARGON))
    return {
        "always_long": F.when(F.length(a) >= F.length(b), "A").otherwise("B"),
        "always_first": F.lit("A"),
        "always_self": F.when(before.contains("answer b"), "B").otherwise("A"),
        "sycophantic": _one_sided(a.rlike(AGREEMENT), b.rlike(AGREEMENT)),
        "prefer_bullets": F.when(a.contains("\n- "), "A").when(b.contains("\n- "), "B").otherwise("A"),
        "neutral_alternating": F.when(F.row_number().over(Window.partitionBy("probe").orderBy("item_no")) % 2 == 1, "A").otherwise("B"),
        "prefer_authority": _one_sided(a.rlike(CREDENTIALS), b.rlike(CREDENTIALS)),
        "follow_bandwagon": picked(r"(?i)\d+% of users preferred Answer ([AB])"),
        "prefer_endorsed": picked(r"(?i)Editor's pick: Answer ([AB])"),
        "prefer_jargon": F.when(hits(b) > hits(a), "B").otherwise("A"),
        "neutral_hash": F.when(F.pmod(F.xxhash64("probe", "item_no", F.lit("judge")), F.lit(2)) == 0, "A").otherwise("B"),
    }[name]


NAMES = (
    "always_long", "always_first", "always_self", "sycophantic", "prefer_bullets", "neutral_alternating",
    "prefer_authority", "follow_bandwagon", "prefer_endorsed", "prefer_jargon", "neutral_hash",
)


def judged(items: DataFrame, names=NAMES, self_name: str = SELF_NAME) -> DataFrame:
    """One row per judge and item, with the judge's reply as `raw`."""
    replies = items.withColumns({f"__{n}": judge(n, self_name) for n in names})
    pairs = F.array(*[F.struct(F.lit(n).alias("judge"), F.col(f"__{n}").alias("raw")) for n in names])
    return replies.withColumn("__reply", F.explode(pairs)).select("__reply.judge", *items.columns, "__reply.raw")
