"""Column helpers for text: binding, splitting and weaving, counting, naming, sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; lambdas get no common-subexpression reuse."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings() -> Column:
    return F.array().cast("array<string>")


def hits(text: Column, regex: str, hint: str | None = None, group: int = 0) -> Column:
    """All matches of ``regex``; ``hint`` is a literal that lets most texts skip the regex."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    if hint is None:
        return F.when(text.isNotNull(), found).otherwise(strings())
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(strings())


def interleave(pieces: Column, between: Column) -> Column:
    """``pieces`` joined with one item of ``between`` after each; a missing item is empty."""
    return F.array_join(
        F.transform(pieces, lambda piece, i: F.concat_ws("", piece, F.get(between, i))), ""
    )


def weave(text: Column, regex: str, replace: Callable[[Column], Column]) -> Column:
    """Replace each match of ``regex`` by ``replace(match)`` without leaving the JVM.

    ``text`` is split at the matches and the pieces are joined again around the new values, so
    ``text`` must be cheap to reference twice (a column or a lambda variable). Text without a match
    costs one search.
    """
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))

    def swap(h: Column) -> Column:
        woven = interleave(F.split(text, regex, -1), F.transform(h, replace))
        return F.when(F.size(h) == 0, text).otherwise(woven)

    return let(found, swap)


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping literal count of ``needle`` in ``text``."""
    left = F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise(
        ((F.length(text) - left) / F.length(needle)).cast("int")
    )


def mask(value: Column) -> Column:
    """Masked sample: the first four and last two characters, or ``***`` when short."""
    trimmed = F.btrim(value, F.lit(WHITESPACE))
    return F.when(F.length(trimmed) <= 8, F.lit("***")).otherwise(
        F.concat(F.substring(trimmed, 1, 4), F.lit("…"), F.right(trimmed, F.lit(2)))
    )


def human_size(num_bytes: Column) -> Column:
    """``B``, whole ``KB`` or one-decimal ``MB``, rounding halves to even."""
    exact = num_bytes.cast("decimal(20,0)")
    kilo = F.bround(exact / F.lit(1024).cast("decimal(4,0)"), 0).cast("bigint").cast("string")
    mega = F.bround(exact / F.lit(1048576).cast("decimal(7,0)"), 1).cast("decimal(20,1)").cast("string")
    return (
        F.when(num_bytes < 1024, F.concat(num_bytes.cast("string"), F.lit(" B")))
        .when(num_bytes < 1024 * 1024, F.concat(kilo, F.lit(" KB")))
        .otherwise(F.concat(mega, F.lit(" MB")))
    )


def header_name(name: Column) -> Column:
    """Lower-cased header name without the leading colons of pseudo-headers."""
    return F.ltrim(F.lower(F.coalesce(name, F.lit(""))), F.lit(":"))


def slug(value: Column) -> Column:
    """File-name-safe token: other characters become single dashes, never empty."""
    dashed = F.btrim(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("x"))


def model_slug(model: Column, prefixes: tuple[str, ...]) -> Column:
    """Slug of a model id after removing each vendor prefix once, in order."""
    out = model
    for prefix in prefixes:
        cut = F.substr(out, F.lit(len(prefix) + 1))
        out = F.when(F.startswith(out, F.lit(prefix)), cut).otherwise(out)
    return slug(out)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def in_list(value: Column, values: list[str] | tuple[str, ...]) -> Column:
    return value.isin(*values) if values else F.lit(False)
