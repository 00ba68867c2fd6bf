"""Heading outline of Markdown responses, and required sections that are missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[^\S\n]"
FENCE = rf"(?dUm)^{BLANK}*```[^\n]*(?:\n(?!{BLANK}*```)[^\n]*)*+(?:\n{BLANK}*```[^\n]*)?"
HEADING = rf"(?dUm)^(#{{1,6}}){BLANK}+(.*)$"


def headings(text: Column) -> Column:
    """``array<struct<level, title>>`` of the headings outside fenced code, in order."""
    prose = F.when(F.contains(text, F.lit("```")), F.regexp_replace(text, FENCE, "")).otherwise(text)
    marks = F.regexp_extract_all(prose, F.lit(HEADING), F.lit(1))
    titles = F.regexp_extract_all(prose, F.lit(HEADING), F.lit(2))
    return F.transform(
        F.arrays_zip(marks.alias("m"), titles.alias("t")),
        lambda h: F.struct(F.length(h["m"]).alias("level"), h["t"].alias("title")),
    )


def outline(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per heading: ``keys``, ``position``, ``level``, ``title``. Narrow."""
    rows = df.select(*keys, F.posexplode(headings(F.col(text))).alias("position", "h"))
    return rows.select(*keys, "position", "h.level", "h.title")


def missing_sections(text: Column, required: Sequence[str]) -> Column:
    """Required heading titles the text lacks; usable in a retry predicate."""
    titles = F.transform(headings(text), lambda h: F.btrim(h["title"]))
    return F.array_except(F.array(*map(F.lit, required)), titles)
