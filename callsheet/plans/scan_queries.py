"""Scan queries over shop and web traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet import rules
from callsheet.functions.slices import spread
from callsheet.functions.text import hits, mask
from callsheet.operators import scan
from callsheet.plans.query import Query
from callsheet.plans.traffic import (
    SHOP_CTE,
    WEB_CTE,
    all_entries,
    captures_of,
    shop_entries,
    web_entries,
)
from callsheet.rules import IPV4_REGEX, TEXT_PATTERNS

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
CREDENTIAL = (
    r'(?i)\\?"([A-Za-z0-9_]*(?:password|passwd|pwd|client_secret|secret|api_?key|access_?token|token))'
    r'\\?"\s*:\s*\\?"([^"\\]{4,})'
)
PATTERNS_SQL = [
    ("private_key", "high", r"(?s)-----BEGIN RSA PRIVATE KEY-----.*?(?:-----END RSA PRIVATE KEY-----|$)"),
    ("private_key", "high", r"(?s)-----BEGIN PRIVATE KEY-----.*?(?:-----END PRIVATE KEY-----|$)"),
    ("aws_access_key", "high", r"\bAKIA[0-9A-Z]{16}\b"),
    ("slack_token", "high", r"xox[baprs]-[0-9A-Za-z-]{10,}"),
    ("google_api_key", "medium", r"AIza[0-9A-Za-z_-]{35}"),
    ("jwt", "medium", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{6,}"),
    ("bearer_token", "medium", r"[Bb]earer\s+[A-Za-z0-9._-]{8,}"),
    ("email", "low", EMAIL),
]
SUB = {"private_key": 0, "aws_access_key": 1, "slack_token": 2, "google_api_key": 3, "jwt": 4, "bearer_token": 5, "email": 6}


def _when(values: dict[str, str], column: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {column} {arms} END"


def _header_sql() -> str:
    parts = []
    for step, where, columns in (
        (0, "request header", {"authorization": "auth", "cookie": "cookie", "x-csrf-token": "csrf"}),
        (1, "response header", {"set-cookie": "set_cookie"}),
    ):
        for name, column in columns.items():
            parts.append(
                f"SELECT capture_id, entry_index, {step} AS step, 0 AS sub, 1 AS pos, 'header:{name}' AS category,"
                f" '{rules.SENSITIVE_HEADERS[name]}' AS severity, '{where}' AS place_name, {column} AS value"
                f" FROM shop WHERE {column} IS NOT NULL"
            )
    return "\nUNION ALL ".join(parts)


def _query_sql() -> str:
    return f"""
SELECT capture_id, entry_index, 2, 0, pos, 'query:' || key, {_when(rules.SENSITIVE_QUERY_KEYS, "key")}, 'url query', value
FROM (
  SELECT capture_id, entry_index, pos, lower(split_part(pair, '=', 1)) AS key, substr(pair, strpos(pair, '=') + 1) AS value
  FROM (
    SELECT capture_id, entry_index, unnest(pairs) AS pair, generate_subscripts(pairs, 1) AS pos
    FROM (SELECT capture_id, entry_index, string_split(substr(url, strpos(url, '?') + 1), '&') AS pairs
          FROM calls WHERE contains(url, '?'))
  ) WHERE contains(pair, '=')
) WHERE value <> '' AND key IN ({", ".join(f"'{k}'" for k in rules.SENSITIVE_QUERY_KEYS)})"""


def _body_sql() -> str:
    parts = []
    for step, side in ((3, "request"), (4, "response")):
        for category, severity, pattern in PATTERNS_SQL:
            parts.append(f"""
SELECT capture_id, entry_index, {step}, {SUB[category]}, pos, '{category}', '{severity}', '{side} body', value
FROM (SELECT capture_id, entry_index, unnest(v) AS value, generate_subscripts(v, 1) AS pos
      FROM (SELECT capture_id, entry_index, regexp_extract_all({side}_body, '{pattern}') AS v FROM calls WHERE {side}_body IS NOT NULL))""")
        high = ", ".join(f"'{k}'" for k in rules.HIGH_CREDENTIAL_FIELDS)
        parts.append(f"""
SELECT capture_id, entry_index, {step}, 7, pos, 'field:' || lower(key),
  CASE WHEN lower(key) IN ({high}) THEN 'high' ELSE 'medium' END, '{side} body', value
FROM (SELECT capture_id, entry_index, unnest(ks) AS key, unnest(vs) AS value, generate_subscripts(vs, 1) AS pos
      FROM (SELECT capture_id, entry_index, regexp_extract_all({side}_body, '{CREDENTIAL}', 1) AS ks,
              regexp_extract_all({side}_body, '{CREDENTIAL}', 2) AS vs FROM calls WHERE {side}_body IS NOT NULL))""")
    return "\nUNION ALL ".join(parts)


SHOP_ROWS = """SELECT capture_id, entry_index, url, request_text AS request_body,
  CASE WHEN lower(response_encoding) = 'base64' THEN NULL ELSE response_text END AS response_body FROM shop"""
WEB_ROWS = """SELECT capture_id, entry_index, url, CAST(NULL AS VARCHAR) AS request_body,
  response_text AS response_body FROM web"""


def raw_cte(*kinds: str) -> str:
    """CTEs up to ``raw``: every finding of the chosen kinds of traffic."""
    ctes = {"shop": SHOP_CTE, "web": WEB_CTE}
    rows = {"shop": SHOP_ROWS, "web": WEB_ROWS}
    found = [_query_sql(), _body_sql()]
    if "shop" in kinds:
        found.insert(0, _header_sql())
    else:
        found[0] = found[0].replace(
            "SELECT capture_id, entry_index, 2, 0, pos, 'query:' || key,",
            "SELECT capture_id, entry_index, 2 AS step, 0 AS sub, pos, 'query:' || key AS category,",
        ).replace(", 'url query', value", " AS severity, 'url query' AS place_name, value")
    joined = "\nUNION ALL ".join(found)
    return (
        ", ".join(ctes[k] for k in kinds)
        + f", calls AS ({' UNION ALL '.join(rows[k] for k in kinds)})"
        + f", raw AS (SELECT * FROM ({joined}) WHERE value <> '{rules.REDACTED_MARKER}')"
    )


ROLLED_CTE = """
masked AS (
  SELECT *, CASE WHEN length(trim(value)) <= 8 THEN '***'
    ELSE substr(trim(value), 1, 4) || '…' || right(trim(value), 2) END AS masked_sample,
    row_number() OVER (PARTITION BY capture_id ORDER BY entry_index, step, sub, pos) AS seen
  FROM raw),
rolled AS (
  SELECT capture_id, category, place_name, masked_sample, count(*) AS occurrences, min(seen) AS first_seen,
    arg_min(severity, seen) AS severity, 'entry[' || CAST(arg_min(entry_index, seen) AS VARCHAR) || ']' AS location
  FROM masked GROUP BY ALL),
capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, category ORDER BY first_seen) AS n FROM rolled)
  WHERE n <= 25)
"""
FINDING_SQL = 'capture_id, category, severity, place_name AS "where", location, masked_sample, occurrences'
FINDING = ["capture_id", "category", "severity", "where", "location", "masked_sample", "occurrences"]
RAW = ["capture_id", "entry_index", "category", "severity", "where", "value"]
RAW_SQL = 'capture_id, entry_index, category, severity, place_name AS "where", value'


def _raw(*prefixes: str):
    def plan(spark, sf_dir) -> DataFrame:
        category = F.col("category")
        wanted = F.lit(False)
        for prefix in prefixes:
            wanted = wanted | F.startswith(category, F.lit(prefix))
        return scan.raw_findings(shop_entries(spark, sf_dir)).filter(wanted).select(*RAW)

    tests = " OR ".join(f"starts_with(category, '{p}')" for p in prefixes)
    return Query(plan, f"WITH {raw_cte('shop')} SELECT {RAW_SQL} FROM raw WHERE {tests}")


def _texts(spark, sf_dir) -> DataFrame:
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        pages.select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    )


TEXTS_SQL = """(SELECT 'd' AS kind, doc_id AS id, text FROM documents
UNION ALL SELECT 'p', page_id, html FROM pages)"""


def _matches(regex: str, hint: str):
    def plan(spark, sf_dir) -> DataFrame:
        found = _texts(spark, sf_dir).select(
            "kind", "id", F.posexplode(hits(F.col("text"), regex, hint)).alias("pos", "value")
        )
        return found.withColumn("masked", mask(F.col("value")))

    return plan


def _matches_sql(pattern: str) -> str:
    return f"""SELECT kind, id, CAST(pos - 1 AS INTEGER) AS pos, value,
  CASE WHEN length(value) <= 8 THEN '***' ELSE substr(value, 1, 4) || '…' || right(value, 2) END AS masked
FROM (SELECT kind, id, unnest(v) AS value, generate_subscripts(v, 1) AS pos
      FROM (SELECT kind, id, regexp_extract_all(text, '{pattern}') AS v FROM {TEXTS_SQL}))"""


def _findings(spark, sf_dir) -> DataFrame:
    return scan.scan(all_entries(spark, sf_dir))


def _report(spark, sf_dir) -> DataFrame:
    entries = all_entries(spark, sf_dir)
    lines = scan.report_lines(scan.scan(entries), captures_of(entries))
    return lines.orderBy(*scan.REPORT_ORDER).select("capture_id", "section", "line")


def _counts(spark, sf_dir) -> DataFrame:
    entries = all_entries(spark, sf_dir)
    return scan.severity_counts(scan.scan(entries), captures_of(entries)).drop("source_har")


ALL = raw_cte("shop", "web")
COUNTS_CTE = f"""
names AS (SELECT DISTINCT capture_id FROM calls),
counted AS (
  SELECT n.capture_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
    count(*) FILTER (severity = 'low') AS low
  FROM names n LEFT JOIN capped f USING (capture_id) GROUP BY n.capture_id),
summed AS (
  SELECT *, high + medium + low > 0 AS has_findings, high > 0 AS has_high,
    CASE WHEN high + medium + low > 0
      THEN 'security scan: ' || high || ' high, ' || medium || ' medium, ' || low
        || ' low distinct secret/PII finding(s) in the RAW HAR'
      ELSE 'security scan: no obvious secrets/PII detected in the raw HAR' END
    || ' (heuristic — review before publishing).' AS summary
  FROM counted)
"""
FIXED_SQL = ", ".join(
    ["'# Security scan — ' || capture_id || '.har'", "''"]
    + [f"'{line}'" for line in scan.REPORT_INTRO]
    + ["''", "summary", "''"]
    + [f"'{line}'" for line in scan.REPORT_HEAD]
)
REPORT_SQL = f"""WITH {ALL}, {ROLLED_CTE}, {COUNTS_CTE}
SELECT capture_id, CAST(n - 1 AS INTEGER) AS section, line
FROM (SELECT capture_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n
      FROM (SELECT capture_id, [{FIXED_SQL}] AS lines FROM summed))
UNION ALL
SELECT capture_id, 10, '| ' || severity || ' | ' || category || ' | ' || place_name || ' | `' || masked_sample
  || '` | ' || occurrences || ' | ' || location || ' |' FROM capped"""

QUERIES = {
    "scan_email": Query(_matches(TEXT_PATTERNS[6].regex, "@"), _matches_sql(EMAIL)),
    "scan_ipv4": Query(_matches(IPV4_REGEX, "."), _matches_sql(IPV4)),
    "scan_headers": _raw("header:"),
    "scan_query_secrets": _raw("query:"),
    "scan_credential_fields": _raw("field:"),
    "scan_jwt_aws_slack_google_bearer": _raw("jwt", "aws_", "slack_", "google_", "bearer_"),
    "scan_private_key": _raw("private_key"),
    "scan_web": Query(
        lambda spark, d: scan.raw_findings(web_entries(spark, d)).select(*RAW),
        f"WITH {raw_cte('web')} SELECT {RAW_SQL} FROM raw",
    ),
    "scan_rollup": Query(
        lambda spark, d: scan.roll_up(scan.raw_findings(all_entries(spark, d))).select(*FINDING),
        f"WITH {ALL}, {ROLLED_CTE} SELECT {FINDING_SQL} FROM rolled",
    ),
    "scan_cap": Query(
        lambda spark, d: _findings(spark, d).select(*FINDING),
        f"WITH {ALL}, {ROLLED_CTE} SELECT {FINDING_SQL} FROM capped",
    ),
    "report_order": Query(
        lambda spark, d: scan.report_order(_findings(spark, d)).select(*FINDING, "severity_rank"),
        f"""WITH {ALL}, {ROLLED_CTE} SELECT {FINDING_SQL},
  CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS INTEGER) AS severity_rank
FROM capped ORDER BY capture_id, severity_rank, category, first_seen""",
    ),
    "severity_counts": Query(
        _counts,
        f"WITH {ALL}, {ROLLED_CTE}, {COUNTS_CTE} SELECT * FROM summed",
    ),
    "report_lines": Query(_report, REPORT_SQL),
}
