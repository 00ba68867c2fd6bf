"""JSON kept as text: strict validation, normal form, string tokens, escaped forms.

The normal form is what Spark's own JSON generator writes: no whitespace, escapes decoded, key
order kept. Objects are never turned into maps or variants, so the order survives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsheet.functions.text import let

#: Every parse raises the parser's own string limit, so that no value is lost for its size.
LONG = {"maxStringLen": str(2**31 - 1)}
STRICT = LONG | {"allowSingleQuotes": "false"}
# One JSON string token. Possessive, so long strings need no regex stack.
STRING_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def normal_form(text: Column) -> Column:
    """``text`` as normalised JSON, or null when it is no JSON value (or is JSON ``null``).

    A JSON string comes back without its quotes.
    """
    return F.from_json(F.concat(F.lit('{"r":'), text, F.lit("}")), "r string", STRICT)["r"]


def is_one_value(text: Column) -> Column:
    """True when ``[text]`` is a list of exactly one value, so ``text`` holds no stray comma."""
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(F.size(F.from_json(wrapped, "array<string>", STRICT)) == 1, F.lit(False))


def is_json(text: Column) -> Column:
    """Strict check: exactly one complete JSON value and nothing else."""
    whole = normal_form(text).isNotNull() | (F.btrim(text, F.lit(" \t\r\n")) == "null")
    return F.coalesce(is_one_value(text) & whole, F.lit(False))


def quote(value: Column) -> Column:
    """``value`` as a JSON string token with its quotes; null stays null."""
    token = let(
        F.to_json(F.struct(value.alias("r"))),
        lambda j: F.substr(j, F.lit(6), F.length(j) - 6),
    )
    return F.when(value.isNotNull(), token)


def unquote(token: Column) -> Column:
    """The text of a JSON string token; tokens without a backslash need no parser."""
    plain = F.substr(token, F.lit(2), F.length(token) - 2)
    parsed = F.from_json(F.concat(F.lit('{"r":'), token, F.lit("}")), "r string", STRICT)["r"]
    return F.when(F.contains(token, F.lit("\\")), parsed).otherwise(plain)


def _ascii_unit(unit: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(unit)), 4, "0"))


def ascii_escaped(escaped: Column) -> Column:
    """``escaped`` with every non-ASCII character written as ``\\uXXXX`` (surrogates as pairs)."""

    def one(char: Column) -> Column:
        code = F.ascii(char).cast("bigint")
        pair = F.concat(
            _ascii_unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)),
            _ascii_unit(F.lit(0xDC00) + F.pmod(code - 0x10000, F.lit(1024))),
        )
        return F.when(code < 128, char).when(code < 0x10000, _ascii_unit(code)).otherwise(pair)

    chars = F.regexp_extract_all(escaped, F.lit("(?s)."), F.lit(0))
    return F.when(
        F.length(escaped) == F.octet_length(escaped), escaped
    ).otherwise(F.array_join(F.transform(chars, one), ""))


def escaped_forms(secret: Column) -> Column:
    """Distinct spellings of ``secret`` inside JSON text, longest first."""

    def forms(escaped: Column) -> Column:
        return F.array_distinct(F.array(secret, escaped, ascii_escaped(escaped)))

    inner = let(quote(secret), lambda q: F.substr(q, F.lit(2), F.length(q) - 2))
    return longest_first(let(inner, forms))


def longest_first(values: Column) -> Column:
    """Array ordered by length descending, then by value."""
    keyed = F.transform(values, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])
