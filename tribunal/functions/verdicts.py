"""Verdict texts as columns: A, B, TIE or INVALID."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("A", "B", "TIE")


#: White space by Unicode, and the four separators that count as such besides.
BLANK = "[\\s\\x1c-\\x1f]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def parse_verdict(text) -> Column:
    """The first that is found: a named choice, a letter in brackets, a leading letter, a word for a tie, a capital A or B by itself.

    Fixed values: these patterns define what a reply means. Letters, white space and word bounds are those of Unicode.
    """
    text = F.col(text) if isinstance(text, str) else text
    t = stripped(text)
    named = F.upper(F.regexp_extract(t, rf"(?iU)(?:answer|option|choice){BLANK}+([AB])\b", 1))
    letters = [F.regexp_extract(t, p, 1) for p in (rf"(?U)\({BLANK}*([AB]){BLANK}*\)", rf"(?U)^{BLANK}*([AB])(?:[\s\x1c-\x1f.,:;!]|$)")]
    found = [F.nullif(x, F.lit("")) for x in (named, *letters)]
    tie = F.when(t.rlike(r"(?iU)\b(tie|draw|equal|neither)\b"), F.lit("TIE"))
    return F.coalesce(*found, tie, F.nullif(F.regexp_extract(t, r"(?U)\b([AB])\b", 1), F.lit("")), F.lit("INVALID"))


def unswap(verdict, swapped) -> Column:
    """A verdict on swapped answers, in terms of the unswapped ones."""
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    return F.when(F.col(swapped) if isinstance(swapped, str) else swapped, F.when(v == "A", "B").when(v == "B", "A").otherwise(v)).otherwise(v)


def is_event(verdict="verdict", bias_side="bias_side") -> Column:
    """Whether the biased side was picked; without a side (answers in both orders), whether the first was."""
    return F.coalesce(F.col(verdict) == F.coalesce(F.col(bias_side), F.lit("A")), F.lit(False))


def probe_of(item_id) -> Column:
    """What stands before the last dash of an item's id; the whole id without a dash."""
    c = F.col(item_id) if isinstance(item_id, str) else item_id
    return F.when(c.contains("-"), F.regexp_extract(c, r"(?s)^(.*)-[^-]*$", 1)).otherwise(c)
