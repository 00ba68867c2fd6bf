"""Defensive reading of one normalised entry: sub-objects first as text, then field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.functions.jsontext import LONG

HEADERS = "array<struct<name:string,value:string>>"


KINDS = {'"': "STRING", "{": "OBJECT", "[": "ARRAY"}


def _holds(raw: Column, key: str, opener: str) -> Column:
    """Whether ``key`` occurs, at any depth of normalised JSON, with a value starting with ``opener``."""
    return F.contains(raw, F.lit(f'"{key}":{opener}'))


def _has(raw: Column, key: str, opener: str) -> Column:
    """True when ``key`` of the object itself holds a value starting with ``opener``.

    The text tells it where ``key`` occurs with one kind of value only. Where a nested object has a
    namesake of another kind, the object's own value is looked up. Most objects name a key once,
    which takes no copy of the text to see.
    """
    some = _holds(raw, key, opener)
    twice = F.octet_length(F.substring_index(raw, f'"{key}":', 2)) < F.octet_length(raw)
    rest = F.replace(raw, F.lit(f'"{key}":{opener}'), F.lit(""))
    value = F.try_variant_get(F.try_parse_json(raw), f"$.{key}", "variant")
    own = F.startswith(F.schema_of_variant(value), F.lit(KINDS[opener]))
    return F.when(some & twice & _holds(rest, key, ""), F.coalesce(own, some)).otherwise(some)


def string_field(raw: Column, parsed: Column, key: str) -> Column:
    """``parsed`` only when the field really is a JSON string."""
    return F.when(_has(raw, key, '"'), parsed)


def objects(items: Column, typed: Column) -> Column:
    """``items`` of a JSON list as text, with null for all but objects; ``typed`` is the same list.

    Objects are told from strings that look like them. A list too big to be typed is judged by its
    text.
    """
    by_type = F.zip_with(
        items, typed, lambda i, t: F.when(F.startswith(F.schema_of_variant(t), F.lit("OBJECT")), i)
    )
    by_text = F.transform(items, lambda i: F.when(F.startswith(i, F.lit("{")), i))
    return F.coalesce(by_type, by_text)


def headers(raw: Column) -> Column:
    """Header objects of a ``headers`` value; junk items are skipped.

    A clean list parses in one go. A list that does not, such as one with a junk item, is read
    item by item.
    """
    whole = F.from_json(raw, HEADERS, LONG)
    items = objects(F.from_json(raw, "array<string>", LONG), F.from_json(raw, "array<variant>", LONG))
    items = F.filter(items, lambda h: h.isNotNull())
    single = F.transform(items, lambda h: F.from_json(h, "name string, value string", LONG))
    complete = F.forall(whole, lambda h: h["name"].isNotNull() & h["value"].isNotNull())
    filled = F.transform(
        single,
        lambda h: F.struct(
            F.coalesce(h["name"], F.lit("")).alias("name"),
            F.coalesce(h["value"], F.lit("")).alias("value"),
        ),
    )
    return F.coalesce(F.when(complete, whole), filled, F.array().cast(HEADERS))


def read_entries(entries: DataFrame) -> DataFrame:
    """Add one column per HAR field that any operator reads; missing and mistyped fields are null.

    ``entry_json`` is parsed once here; each sub-object is parsed once in a later projection. There
    is no filter: one on a parsed field would be pushed down and make Spark parse twice. The
    sources see to it that every entry is an object.
    """
    top = entries.withColumn(
        "_e",
        F.from_json(
            "entry_json", "request string, response string, startedDateTime string, time double", LONG
        ),
    )
    sides = top.select(
        "*",
        *[
            F.when(
                _has(F.col("entry_json"), side, "{") & F.startswith(f"_e.{side}", F.lit("{")),
                F.col(f"_e.{side}"),
            ).alias(side)
            for side in ("request", "response")
        ],
        string_field(F.col("entry_json"), F.col("_e.startedDateTime"), "startedDateTime").alias(
            "started_at"
        ),
        F.col("_e.time").alias("time_ms"),
    ).drop("_e")
    body = "headers string, postData string, content string"
    parsed = sides.withColumn(
        "_q", F.from_json("request", f"method string, url string, {body}", LONG)
    ).withColumn("_p", F.from_json("response", f"status string, {body}", LONG))
    listed = parsed.select(
        "*",
        *[
            F.when(_has(F.col(side), "headers", "["), F.col(f"{ref}.headers")).alias(f"_{side}_h")
            for side, ref in (("request", "_q"), ("response", "_p"))
        ],
    )
    flat = listed.select(
        *sides.columns,
        F.coalesce("_q.method", F.lit("")).alias("method"),
        F.coalesce("_q.url", F.lit("")).alias("url"),
        F.col("_p.status").alias("status_text"),
        headers(F.col("_request_h")).alias("request_headers"),
        headers(F.col("_response_h")).alias("response_headers"),
        *[
            F.when(_has(F.col(side), key, "{"), F.col(f"{ref}.{key}")).alias(f"_{side}_{key}")
            for side, ref in (("request", "_q"), ("response", "_p"))
            for key in ("postData", "content")
        ],
    )
    names = [f"_{s}_{k}" for s in ("request", "response") for k in ("postData", "content")]
    fields = "mimeType string, text string, size bigint, encoding string"
    out = flat
    for name in names:
        out = out.withColumn(f"{name}_p", F.from_json(name, fields, LONG))
    return out.select(
        *[c for c in flat.columns if c not in names],
        *[
            F.struct(
                string_field(F.col(n), F.col(f"{n}_p.mimeType"), "mimeType").alias("mime"),
                string_field(F.col(n), F.col(f"{n}_p.text"), "text").alias("text"),
                F.col(f"{n}_p.size").alias("size"),
                string_field(F.col(n), F.col(f"{n}_p.encoding"), "encoding").alias("encoding"),
            ).alias(n.strip("_"))
            for n in names
        ],
    )


def has_both_sides(entry_json: Column) -> Column:
    """False when request or response is surely no object; told from the text, without parsing."""
    return _holds(entry_json, "request", "{") & _holds(entry_json, "response", "{")


def is_base64(encoding: Column) -> Column:
    return F.coalesce(F.lower(encoding) == "base64", F.lit(False))


def body_text(side: str) -> Column:
    """Text of a side's body: ``postData.text``, else ``content.text`` unless base64."""
    post, content = F.col(f"{side}_postData"), F.col(f"{side}_content")
    return F.coalesce(post["text"], F.when(~is_base64(content["encoding"]), content["text"]))
