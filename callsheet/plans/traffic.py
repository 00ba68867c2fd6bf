"""Captures derived from the given tables: orders as API traffic, pages and documents as web traffic.

One SELECT per kind of traffic runs in Spark and, unchanged, in the SQL that checks the results.
A third of the orders belong to one capture, so every query meets a hot key. Secret-looking
values are put together from hashes and pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.functions.slices import spread

# Columns of one HTTP call; null means "not in the capture".
SHOP_SQL = """
SELECT
  CASE WHEN k % 3 = 0 THEN 'shop-bulk'
       ELSE 'shop-' || CAST(CAST(floor(k / 60) AS BIGINT) AS STRING) END AS capture_id,
  CAST(CASE WHEN k % 3 = 0 THEN floor(k / 3) ELSE k % 60 END AS BIGINT) AS entry_index,
  k,
  d || 'T00:00:00.000Z' AS started,
  k % 500 + 0.5e0 AS time_ms,
  CASE k % 10 WHEN 0 THEN 'HEAD' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'GET' END AS method,
  'https://' || CASE WHEN k % 17 = 0 THEN 'CDN.example.com' ELSE 'api.example.com' END
    || '/v1/vehicle/' || vin || '/user/' || uid || '/geo/' || ip
    || CASE k % 7 WHEN 0 THEN '?Access_Token=' || s
                  WHEN 1 THEN '?page=2&sig=' || substr(s, 1, 6) || '&token'
                  WHEN 2 THEN '?token=<REDACTED>&key=k' || substr(s, 7, 9) || '&key='
                  WHEN 3 THEN '?q=a=b&signature=' || substr(s, 3, 12) || '=='
                  ELSE '' END AS url,
  CASE k % 13 WHEN 0 THEN 204 WHEN 1 THEN 304 WHEN 2 THEN 101 WHEN 3 THEN 404 ELSE 200 END AS status,
  CASE WHEN k % 4 = 0 THEN 'Bearer ' || s END AS auth,
  CASE WHEN k % 9 = 0 THEN 'sid="' || substr(s, 1, 12) || '"; theme=dark' END AS cookie,
  CASE WHEN k % 11 = 0 THEN '' END AS csrf,
  CASE WHEN k % 5 = 0 THEN 'session=' || substr(s, 5, 16) || '; HttpOnly' END AS set_cookie,
  CASE WHEN k % 2 = 0 THEN 'no-cache' END AS cache_control,
  CASE WHEN k % 10 IN (1, 2) THEN 'application/json' END AS request_mime,
  CASE WHEN k % 10 IN (1, 2) THEN
    '{"email":"user' || CAST(k % 89 AS STRING) || '@mail.example.com","userPassword":"pw-' || substr(s, 1, 10)
    || '","password":"' || substr(s, 9, 8) || '","note":"' || uid || '"}' END AS request_text,
  CASE k % 8 WHEN 3 THEN 'text/html' WHEN 4 THEN 'image/png' WHEN 6 THEN 'Application/Problem+JSON'
             ELSE 'application/json' END AS response_mime,
  CASE k % 8
    WHEN 0 THEN '{"vin":"' || vin || '","deviceId":"' || imei || '","city":"' || city
      || '","n":{"ip":"' || ip || '","zip":"' || zip || '"},"display_name":"' || person
      || '","repairerName":"Garage ' || city || '","total":' || CAST(k AS STRING)
      || ',"ids":["' || uid || '","x"]}'
    WHEN 1 THEN '[{"orderKey":' || CAST(k AS STRING) || ',"priority":"' || priority || '"},[],{}]'
    WHEN 2 THEN '{"broken":"' || s || '"'
    WHEN 3 THEN '<p>mail to help' || CAST(k % 7 AS STRING) || '@example.org or ' || ip || '</p><script>{"display_name": "'
      || person || '","city":"' || city || '"}</script><p>' || person || ' drives ' || vin || '</p>'
    WHEN 4 THEN 'iVBORw0KGgo' || s
    WHEN 5 THEN CASE k % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"plain ' || person || '"' ELSE CAST(k AS STRING) END
    WHEN 6 THEN CASE WHEN k % 512 = 6 THEN '{"blob":"' || repeat('x', 25000) || '"}' ELSE '' END
    ELSE '{"apiToken":"' || s || '","awsKey":"' || 'AK' || 'IA' || upper(substr(s, 1, 16))
      || '","chat":"' || 'xo' || 'xb-' || substr(s, 1, 14) || '","maps":"' || 'AI' || 'za' || s || substr(s, 1, 3)
      || '","jwt":"' || 'ey' || 'J' || substr(s, 1, 12) || '.' || substr(s, 5, 15) || '.' || substr(s, 11, 9)
      || '","auth":"bearer ' || substr(s, 2, 20)
      || '","pem":"-----BEGIN ' || CASE WHEN k % 16 = 7 THEN 'RSA ' ELSE '' END || 'PRIVATE KEY-----' || s
      || CASE WHEN k % 32 = 15 THEN '' ELSE '-----END ' || CASE WHEN k % 16 = 7 THEN 'RSA ' ELSE '' END || 'PRIVATE KEY-----' END
      || '","city":"' || city || '"}'
  END AS response_text,
  CASE WHEN k % 8 = 3 AND k % 5 = 0 THEN CAST(k * 1000 AS BIGINT) END AS response_size,
  CASE WHEN k % 8 = 4 THEN 'Base64' END AS response_encoding,
  vin, uid, imei, ip, city, zip, person
FROM (
  SELECT o_orderkey AS k, substr(CAST(o_orderdate AS STRING), 1, 10) AS d, o_orderpriority AS priority,
    md5(CAST(o_orderkey % 701 AS STRING)) AS s,
    'WVW' || upper(substr(md5(CAST(o_custkey AS STRING)), 1, 14)) AS vin,
    substr(md5(CAST(o_custkey AS STRING)), 1, 8) || '-' || substr(md5(CAST(o_custkey AS STRING)), 9, 4) || '-'
      || substr(md5(CAST(o_custkey AS STRING)), 13, 4) || '-' || substr(md5(CAST(o_custkey AS STRING)), 17, 4) || '-'
      || substr(md5(CAST(o_custkey AS STRING)), 21, 12) AS uid,
    CAST(350000000000000 + o_custkey AS STRING) AS imei,
    '198.51.' || CAST(o_custkey % 200 AS STRING) || '.' || CAST(o_custkey % 113 AS STRING) AS ip,
    CASE o_custkey % 4 WHEN 0 THEN 'Hamburg' WHEN 1 THEN 'Bremen' WHEN 2 THEN 'Ulm' ELSE 'Jena' END AS city,
    CAST(10000 + o_custkey AS STRING) || '-Z' AS zip,
    'Person ' || CAST(o_custkey AS STRING) AS person
  FROM orders
) o
"""

WEB_SQL = """
SELECT 'web-' || CAST(CAST(floor(page_id / 25) AS BIGINT) AS STRING) AS capture_id,
  CAST(page_id % 25 AS BIGINT) AS entry_index, url, 'text/html' AS response_mime, html AS response_text
FROM pages
UNION ALL
SELECT 'doc-' || CAST(CAST(floor(doc_id / 40) AS BIGINT) AS STRING), CAST(doc_id % 40 AS BIGINT),
  'https://docs.example.com/' || lang || '/' || CAST(doc_id AS STRING), 'text/plain; charset=utf-8', text
FROM documents
"""

REQUEST_HEADERS = {
    "Accept": "'application/json'",
    "Authorization": "auth",
    ":Authority": "'api.example.com'",
    "Cookie": "cookie",
    "X-CSRF-Token": "csrf",
}
RESPONSE_HEADERS = {
    "Content-Type": "response_mime",
    "Set-Cookie": "set_cookie",
    "Cache-Control": "cache_control",
    "Server": "'edge-1'",
    "server": "'edge-2'",
}


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for table in tables:
        rows = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        view = f"callsheet_{table}"
        rows.createOrReplaceTempView(view)
        sql = sql.replace(f"FROM {table}\n", f"FROM {view}\n")
    return spark.sql(sql)


def shop_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SHOP_SQL, "orders")


def web_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, WEB_SQL, "pages", "documents")


def _header_array(names: dict[str, str]):
    items = [
        F.struct(F.lit(name).alias("name"), F.expr(value).alias("value"))
        for name, value in names.items()
    ]
    return F.filter(F.array(*items), lambda h: h["value"].isNotNull())


def shop_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per order, already in normal form; null parts are left out."""
    request = F.struct(
        "method",
        "url",
        _header_array(REQUEST_HEADERS).alias("headers"),
        F.when(
            F.col("request_text").isNotNull(),
            F.struct(F.col("request_mime").alias("mimeType"), F.col("request_text").alias("text")),
        ).alias("postData"),
    )
    content = F.struct(
        F.col("response_size").alias("size"),
        F.col("response_mime").alias("mimeType"),
        F.col("response_text").alias("text"),
        F.col("response_encoding").alias("encoding"),
    )
    response = F.struct(
        "status", _header_array(RESPONSE_HEADERS).alias("headers"), content.alias("content")
    )
    entry = F.struct(
        F.col("started").alias("startedDateTime"),
        F.col("time_ms").alias("time"),
        request.alias("request"),
        response.alias("response"),
    )
    return shop_calls(spark, sf_dir).select(
        "capture_id", "entry_index", F.to_json(entry).alias("entry_json")
    )


def web_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per page and per document."""
    content = F.struct(F.col("response_mime").alias("mimeType"), F.col("response_text").alias("text"))
    entry = F.struct(
        F.struct(F.lit("GET").alias("method"), "url").alias("request"),
        F.struct(F.lit(200).alias("status"), content.alias("content")).alias("response"),
    )
    return web_calls(spark, sf_dir).select(
        "capture_id", "entry_index", F.to_json(entry).alias("entry_json")
    )


def all_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop_entries(spark, sf_dir).unionByName(web_entries(spark, sf_dir))


def captures_of(entries: DataFrame) -> DataFrame:
    """One row per capture, named like a file."""
    return entries.select("capture_id").distinct().withColumn(
        "source_har", F.concat("capture_id", F.lit(".har"))
    )


def har_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small HAR text per order: a call, a junk item, a call without response; some malformed."""
    order = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    key = F.col("o_orderkey").cast("string")
    return order.select(
        key.alias("capture_id"),
        F.concat(key, F.lit(".har")).alias("source_har"),
        F.concat(
            F.lit('{"log": {"entries": [{"request": {"method": "GET", "url": "https://x/'),
            key,
            F.lit('"}, "response": {"status": "200"}}, 5, {"request": {"url": "https://y/"}}]}}'),
            F.when(F.col("o_orderkey") % 10 == 3, F.lit(" x")).otherwise(""),
        ).alias("har_text"),
    )


# --- The same calls in the checking SQL ------------------------------------------------------
SHOP_CTE = f"shop AS ({SHOP_SQL})"
WEB_CTE = f"web AS ({WEB_SQL})"


def json_string(expression: str) -> str:
    """SQL for a JSON string literal of ``expression``."""
    return f"CAST(to_json({expression}) AS VARCHAR)"


def _headers_sql(names: dict[str, str]) -> str:
    items = [
        f"""CASE WHEN {value} IS NOT NULL THEN '{{"name":"{name}","value":' || {json_string(value)} || '}}' END"""
        for name, value in names.items()
    ]
    return f"'[' || concat_ws(',', {', '.join(items)}) || ']'"


SHOP_ENTRY_SQL = f"""
'{{"startedDateTime":' || {json_string("started")} || ',"time":' || CAST(time_ms AS VARCHAR)
|| ',"request":{{"method":' || {json_string("method")} || ',"url":' || {json_string("url")}
|| ',"headers":' || {_headers_sql(REQUEST_HEADERS)}
|| CASE WHEN request_text IS NULL THEN '' ELSE ',"postData":{{"mimeType":"application/json","text":'
   || {json_string("request_text")} || '}}' END
|| '}},"response":{{"status":' || CAST(status AS VARCHAR) || ',"headers":' || {_headers_sql(RESPONSE_HEADERS)}
|| ',"content":{{' || CASE WHEN response_size IS NULL THEN '' ELSE '"size":' || CAST(response_size AS VARCHAR) || ',' END
|| '"mimeType":' || {json_string("response_mime")} || ',"text":' || {json_string("response_text")}
|| CASE WHEN response_encoding IS NULL THEN '' ELSE ',"encoding":' || {json_string("response_encoding")} END
|| '}}}}}}'
"""
