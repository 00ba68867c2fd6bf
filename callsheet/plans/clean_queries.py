"""Cleaner queries over shop and web traffic, and HAR texts built from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.functions.entry import read_entries
from callsheet.functions.jsontext import is_json, normal_form
from callsheet.functions.slices import spread
from callsheet.functions.text import human_size
from callsheet.operators import clean
from callsheet.plans.query import Query
from callsheet.plans.traffic import (
    SHOP_CTE,
    WEB_CTE,
    captures_of,
    har_texts,
    json_string,
    shop_entries,
    web_entries,
)
from callsheet.rules import CleanRules
from callsheet.sources.har import explode_entries, split_valid

SIZE_SQL = """CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B'
  WHEN {n} < 1048576 THEN CAST(CAST(round_even({n} / 1024.0, 0) AS BIGINT) AS VARCHAR) || ' KB'
  ELSE printf('%.1f MB', {n} / 1048576.0) END"""


def _body_sql(side: str, gate: str, size: str, encoding: str) -> str:
    text, mime = f"{side}_text", f"{side}_mime"
    num = f"CASE WHEN {size} > 0 THEN {size} WHEN {encoding} THEN NULL ELSE octet_length(encode({text})) END"
    return f"""
  CASE WHEN NOT ({gate}) OR {text} IS NULL OR {text} = '' THEN 'none'
       WHEN contains(lower({mime}), 'json') AND NOT {encoding} AND length({text}) <= 20000 AND json_valid({text})
       THEN CASE WHEN {text} = 'null' THEN 'none' WHEN starts_with({text}, '{{') THEN 'object'
                 WHEN starts_with({text}, '[') THEN 'array' ELSE 'scalar' END
       ELSE 'stripped' END AS {side}_body_kind,
  '<stripped: ' || {mime} || coalesce(', ' || {SIZE_SQL.format(n=f"({num})")}, '')
    || CASE WHEN length({text}) > 20000 THEN ' (oversized)' ELSE '' END || '>' AS {side}_marker"""


ALLOWED = "NOT (method = 'HEAD' OR status IN (204, 304) OR status BETWEEN 100 AND 199)"
CALLS_CTE = f"""{SHOP_CTE}, kinds AS (
SELECT *, {_body_sql("request", "true", "CAST(NULL AS BIGINT)", "false")},
  {_body_sql("response", ALLOWED, "response_size", "coalesce(lower(response_encoding) = 'base64', false)")}
FROM shop), calls AS (
SELECT *,
  CASE request_body_kind WHEN 'none' THEN NULL WHEN 'stripped' THEN request_marker ELSE request_text END AS request_body,
  CASE response_body_kind WHEN 'none' THEN NULL WHEN 'stripped' THEN response_marker ELSE response_text END AS response_body
FROM kinds)"""
TOTALS_SELECT = """SELECT capture_id, capture_id || '.har' AS source_har, count(*) AS total_entries, count(*) AS kept_calls,
  count(*) FILTER (request_body_kind IN ('object', 'array') OR response_body_kind IN ('object', 'array')) AS json_body_count,
  min(entry_index) AS first_call,
  'Kept ' || count(*) || '/' || count(*) || ' call envelopes (' || count(*) FILTER (
    request_body_kind IN ('object', 'array') OR response_body_kind IN ('object', 'array')) || ' with JSON bodies)' AS summary
FROM calls GROUP BY capture_id"""
TOTALS_SQL = f"WITH {CALLS_CTE} {TOTALS_SELECT}"

HEADER_ROWS = {
    "request": {"authorization": ("auth", True), "cookie": ("cookie", True)},
    "response": {
        "set-cookie": ("set_cookie", True),
        "cache-control": ("cache_control", False),
        "server": ("'edge-1'", False),
    },
}
HEADERS_SQL = f"WITH {SHOP_CTE} " + " UNION ALL ".join(
    f"SELECT capture_id, entry_index, '{side}' AS side, '{name}' AS name, "
    f"{repr('<redacted>') if masked else column} AS value FROM shop WHERE {column} IS NOT NULL"
    for side, names in HEADER_ROWS.items()
    for name, (column, masked) in names.items()
)


def _map_sql(side: str) -> str:
    items = ", ".join(
        f"CASE WHEN {column} IS NOT NULL THEN '\"{name}\":' || "
        + ("'\"<redacted>\"'" if masked else json_string(column))
        + " END"
        for name, (column, masked) in HEADER_ROWS[side].items()
    )
    return f"'{{' || concat_ws(',', {items}) || '}}'"


def _json_body_sql(side: str) -> str:
    return (
        f"CASE {side}_body_kind WHEN 'none' THEN 'null' WHEN 'stripped' THEN {json_string(side + '_body')}"
        f" ELSE {side}_body END"
    )


CALL_JSON_SQL = f"""'{{"method":' || {json_string("method")} || ',"url":' || {json_string("url")}
 || ',"status":' || status || ',"started_at":' || {json_string("started")} || ',"time_ms":' || time_ms
 || ',"request_content_type":' || coalesce({json_string("request_mime")}, 'null')
 || ',"response_content_type":' || {json_string("response_mime")}
 || ',"request_headers":' || {_map_sql("request")} || ',"response_headers":' || {_map_sql("response")}
 || ',"request_body":' || {_json_body_sql("request")} || ',"response_body":' || {_json_body_sql("response")} || '}}'"""
PARTS_SQL = f"""WITH {CALLS_CTE}, totals AS ({TOTALS_SELECT})
SELECT capture_id, CAST(-1 AS BIGINT) AS part,
  '{{"source_har":"' || source_har || '","total_entries":' || total_entries || ',"calls":[' AS text FROM totals
UNION ALL
SELECT capture_id, entry_index, CASE WHEN entry_index = first_call THEN '' ELSE ',' END || {CALL_JSON_SQL}
FROM calls JOIN totals USING (capture_id)
UNION ALL
SELECT capture_id, 4611686018427387904, '],"json_body_count":' || json_body_count || '}}' FROM totals"""

ENVELOPE = clean.CALL[:7]


def _calls(spark, sf_dir, rules: CleanRules = CleanRules()) -> DataFrame:
    return clean.preprocess(shop_entries(spark, sf_dir), rules)


def _headers(spark, sf_dir) -> DataFrame:
    calls = _calls(spark, sf_dir)
    sides = [
        calls.select("capture_id", "entry_index", F.lit(s).alias("side"), F.inline(F.map_entries(f"{s}_headers")).alias("name", "value"))
        for s in ("request", "response")
    ]
    return sides[0].unionByName(sides[1])


def _bodies(calls: DataFrame) -> DataFrame:
    columns = ("request_body_kind", "request_body", "response_body_kind", "response_body")
    return calls.select("capture_id", "entry_index", *columns)


def _totals(spark, sf_dir) -> DataFrame:
    entries = shop_entries(spark, sf_dir)
    return clean.capture_totals(captures_of(entries), entries, clean.preprocess(entries))


def _parts(spark, sf_dir) -> DataFrame:
    entries = shop_entries(spark, sf_dir)
    calls = clean.preprocess(entries)
    totals = clean.capture_totals(captures_of(entries), entries, calls)
    return clean.artifact_parts(totals, calls)


def _har(spark, sf_dir) -> DataFrame:
    valid, _ = split_valid(har_texts(spark, sf_dir))
    read = read_entries(explode_entries(valid))
    return read.select("capture_id", "entry_index", "method", "url", F.col("response").isNotNull().alias("answered"))


def _two_sided(spark, sf_dir) -> DataFrame:
    """Calls with both sides, beside the entries that were seen: one in two has no response."""
    valid, _ = split_valid(har_texts(spark, sf_dir))
    entries = explode_entries(valid)
    calls = clean.preprocess(entries)
    totals = clean.capture_totals(valid, entries, calls)
    kept = calls.select("capture_id", "entry_index", "url", "status")
    return kept.join(totals.select("capture_id", "total_entries", "kept_calls"), "capture_id")


def _documents(spark, sf_dir) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sizes(spark, sf_dir) -> DataFrame:
    size = F.octet_length("text").cast("bigint") * (F.col("doc_id") % 97 + 1) * (F.col("doc_id") % 13 + 1)
    return _documents(spark, sf_dir).select("doc_id", size.alias("n"), human_size(size).alias("label"))


def _strict(spark, sf_dir) -> DataFrame:
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("event_id") % len(TAILS)).cast("int"))
    rows = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).select(
        "event_id", F.concat("props", tail).alias("t")
    )
    ok = is_json(F.col("t"))
    return rows.select("event_id", ok.alias("ok"), F.when(ok, normal_form(F.col("t"))).alias("normal"))


TAILS = ("", " x", ",1", "}", "]", " ", ",{}")
TAIL_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TAILS)) + " END"


def _forbidden(spark, sf_dir) -> DataFrame:
    return (
        _calls(spark, sf_dir)
        .groupBy("method", "status", clean.forbids_body(F.col("method"), F.col("status")).alias("bodyless"))
        .agg(F.count("*").alias("calls"), F.count("response_body").alias("bodies"))
    )


QUERIES = {
    "har_entries": Query(
        _har,
        """SELECT CAST(o_orderkey AS VARCHAR) AS capture_id, i AS entry_index, CASE i WHEN 0 THEN 'GET' ELSE '' END AS method,
  CASE i WHEN 0 THEN 'https://x/' || o_orderkey ELSE 'https://y/' END AS url, i = 0 AS answered
FROM orders, (VALUES (CAST(0 AS BIGINT)), (2)) v(i) WHERE o_orderkey % 10 <> 3""",
    ),
    "two_sided_calls": Query(
        _two_sided,
        """SELECT CAST(o_orderkey AS VARCHAR) AS capture_id, CAST(0 AS BIGINT) AS entry_index, 'https://x/' || o_orderkey AS url,
  200 AS status, CAST(2 AS BIGINT) AS total_entries, CAST(1 AS BIGINT) AS kept_calls FROM orders WHERE o_orderkey % 10 <> 3""",
    ),
    "har_rejects": Query(
        lambda spark, d: split_valid(har_texts(spark, d))[1],
        """SELECT CAST(o_orderkey AS VARCHAR) AS capture_id, o_orderkey || '.har' AS source_har,
  'expected a top-level JSON object' AS reason FROM orders WHERE o_orderkey % 10 = 3""",
    ),
    "json_strict": Query(
        _strict,
        f"""SELECT event_id, event_id % 7 IN (0, 5) AS ok,
  CASE WHEN event_id % 7 IN (0, 5) THEN replace(props, ' ', '') END AS normal FROM (SELECT *, {TAIL_SQL} AS tail FROM events)""",
    ),
    "envelope": Query(
        lambda spark, d: _calls(spark, d).select("capture_id", "entry_index", *ENVELOPE),
        f"""WITH {SHOP_CTE} SELECT capture_id, entry_index, method, url, CAST(status AS INTEGER) AS status, started AS started_at,
  CAST(time_ms AS DOUBLE) AS time_ms, request_mime AS request_content_type, response_mime AS response_content_type FROM shop""",
    ),
    "header_select": Query(_headers, HEADERS_SQL),
    "body_policy": Query(
        lambda spark, d: _bodies(_calls(spark, d)),
        f"""WITH {CALLS_CTE} SELECT capture_id, entry_index, request_body_kind, request_body, response_body_kind, response_body
FROM calls""",
    ),
    "strip_web": Query(
        lambda spark, d: _bodies(clean.preprocess(web_entries(spark, d))),
        f"""WITH {WEB_CTE}, n AS (SELECT *, octet_length(encode(response_text)) AS n FROM web)
SELECT capture_id, entry_index, 'none' AS request_body_kind, CAST(NULL AS VARCHAR) AS request_body,
  CASE WHEN response_text = '' THEN 'none' ELSE 'stripped' END AS response_body_kind,
  CASE WHEN response_text <> '' THEN '<stripped: ' || response_mime || ', ' || {SIZE_SQL.format(n="n")}
    || CASE WHEN length(response_text) > 20000 THEN ' (oversized)' ELSE '' END || '>' END AS response_body
FROM n""",
    ),
    "human_size": Query(
        _sizes,
        f"""SELECT doc_id, n, {SIZE_SQL.format(n="n")} AS label FROM (
  SELECT doc_id, octet_length(encode(text)) * (doc_id % 97 + 1) * (doc_id % 13 + 1) AS n FROM documents)""",
    ),
    "bodyless_status": Query(
        _forbidden,
        f"""WITH {CALLS_CTE} SELECT method, CAST(status AS INTEGER) AS status, NOT {ALLOWED} AS bodyless, count(*) AS calls,
  count(response_body) AS bodies FROM calls GROUP BY ALL""",
    ),
    "url_exclusion": Query(
        lambda spark, d: _calls(spark, d, CleanRules(exclude_url_substrings=("cdn.example.com",))).select(
            "capture_id", "entry_index", "url"
        ),
        f"WITH {SHOP_CTE} SELECT capture_id, entry_index, url FROM shop WHERE NOT contains(lower(url), 'cdn.example.com')",
    ),
    "json_counts": Query(_totals, TOTALS_SQL),
    "artifact_parts": Query(_parts, PARTS_SQL),
}
