"""Secret and personal-data scan: raw findings, roll-up, cap, severities, report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsheet import rules
from callsheet.functions.entry import body_text, read_entries
from callsheet.functions.lineage import cut_lineage
from callsheet.functions.text import header_name, hits, literal_map, mask
from callsheet.schemas import HIT
from callsheet.sources.ranges import cut_files, entries_of

# Reading order as one number: entry, step, pattern, position. A fixed-width key lets the roll-up
# run as a hash aggregation with map-side combine.
PER_ENTRY = 10**12
PER_DETECTOR = 10**10
PLACE = "decimal(35,0)"


def place_of() -> Column:
    """Encounter position of a raw finding, comparable within its capture."""
    detector = (F.col("step") * 8 + F.col("sub")).cast("bigint") * F.lit(PER_DETECTOR)
    base = F.col("entry_index").cast("decimal(20,0)") * F.lit(PER_ENTRY).cast("decimal(13,0)")
    return (base + (detector + F.col("pos")).cast("decimal(14,0)")).cast(PLACE)


CREDENTIALS = len(rules.TEXT_PATTERNS)
WHERE = ("request header", "response header", "url query", "request body", "response body")


def _hit(step: int, sub: Column, pos: Column, key: Column, value: Column) -> Column:
    return F.struct(
        F.lit(step).alias("step"),
        sub.cast("int").alias("sub"),
        pos.cast("int").alias("pos"),
        key.alias("key"),
        value.alias("value"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{HIT}>")


def header_hits(headers: Column, step: int) -> Column:
    """Sensitive headers of one side; an empty value still counts."""
    named = F.transform(
        headers, lambda h, i: _hit(step, F.lit(0), i, header_name(h["name"]), h["value"])
    )
    return F.filter(named, lambda h: h["key"].isin(*rules.SENSITIVE_HEADERS))


def query_hits(url: Column, step: int = 2) -> Column:
    """Sensitive query parameters: after the first ``?``, undecoded, fragment not cut off."""
    pairs = F.split(F.substr(url, F.locate("?", url) + 1), "&", -1)

    def one(pair: Column, i: Column) -> Column:
        cut = F.position(F.lit("="), pair)
        key = F.lower(F.substr(pair, F.lit(1), F.greatest(cut - 1, F.lit(0))))
        value = F.when(cut > 0, F.substr(pair, cut + 1)).otherwise("")
        return _hit(step, F.lit(0), i, key, value)

    found = F.filter(
        F.transform(pairs, one),
        lambda h: h["key"].isin(*rules.SENSITIVE_QUERY_KEYS) & (h["value"] != ""),
    )
    return F.when(F.contains(url, F.lit("?")), found).otherwise(_none())


def pattern_hits(text: Column, step: int) -> Column:
    """Matches of every body detector, in reporting order; ``key`` is null."""
    per_pattern = F.array(*[hits(text, p.regex, p.hint) for p in rules.TEXT_PATTERNS])
    null = F.lit(None).cast("string")
    return F.flatten(
        F.transform(
            per_pattern, lambda found, k: F.transform(found, lambda m, i: _hit(step, k, i, null, m))
        )
    )


def credential_hits(text: Column, step: int) -> Column:
    """Credential fields ``"<prefix>password": "value"``; ``key`` is the lower-cased field name."""

    def one(m: Column, i: Column) -> Column:
        key = F.lower(F.regexp_extract(m, rules.CREDENTIAL_FIELD, 1))
        value = F.regexp_extract(m, rules.CREDENTIAL_FIELD, 2)
        return _hit(step, F.lit(CREDENTIALS), i, key, value)

    return F.transform(hits(text, rules.CREDENTIAL_FIELD, '"'), one)


def _classified(found: DataFrame) -> DataFrame:
    """Category, severity and place name of each hit."""
    step, sub, key = F.col("step"), F.col("sub"), F.col("key")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), sub)
    kind = (
        F.when(step <= 1, F.concat(F.lit("header:"), key))
        .when(step == 2, F.concat(F.lit("query:"), key))
        .when(sub == CREDENTIALS, F.concat(F.lit("field:"), key))
        .otherwise(pick([p.category for p in rules.TEXT_PATTERNS]))
    )
    credential = F.when(key.isin(*rules.HIGH_CREDENTIAL_FIELDS), "high").otherwise("medium")
    severity = (
        F.when(step <= 1, literal_map(rules.SENSITIVE_HEADERS)[key])
        .when(step == 2, literal_map(rules.SENSITIVE_QUERY_KEYS)[key])
        .when(sub == CREDENTIALS, credential)
        .otherwise(pick([p.severity for p in rules.TEXT_PATTERNS]))
    )
    place = F.get(F.array(*map(F.lit, WHERE)), step)
    return found.select(
        "capture_id",
        "entry_index",
        "step",
        "sub",
        "pos",
        kind.alias("category"),
        severity.alias("severity"),
        place.alias("where"),
        "value",
    )


def raw_findings(entries: DataFrame) -> DataFrame:
    """Every detected value, one row each, with its place in reading order.

    Reads entry text only and is independent of the cleaner. Narrow: no shuffle.
    """
    read = read_entries(entries).select(
        "capture_id",
        "entry_index",
        "url",
        "request_headers",
        "response_headers",
        body_text("request").alias("request_body"),
        body_text("response").alias("response_body"),
    )
    found = F.concat(
        header_hits(F.col("request_headers"), 0),
        header_hits(F.col("response_headers"), 1),
        query_hits(F.col("url")),
        *[
            hits_of(F.col(f"{side}_body"), step)
            for step, side in ((3, "request"), (4, "response"))
            for hits_of in (pattern_hits, credential_hits)
        ],
    )
    rows = read.select("capture_id", "entry_index", F.explode(found).alias("f"))
    return _classified(
        rows.select("capture_id", "entry_index", "f.*").filter(
            F.col("value") != rules.REDACTED_MARKER
        )
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(rules.SEVERITY_RANK))
    for name, position in rules.SEVERITY_RANK.items():
        rank = F.when(severity == name, position).otherwise(rank)
    return rank.cast("int")


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, rules.SEVERITY_RANK)), rank)


def roll_up(raw: DataFrame) -> DataFrame:
    """Distinct (category, where, masked sample) per capture with count and first place.

    Count and minimum combine before the shuffle, so a key that fills a third of the input
    reaches its reducer as one row per input partition.
    """
    return (
        raw.select(
            "capture_id",
            "category",
            "where",
            mask(F.col("value")).alias("masked_sample"),
            place_of().alias("place"),
            severity_rank(F.col("severity")).alias("severity_rank"),
        )
        .groupBy("capture_id", "category", "where", "masked_sample")
        .agg(
            F.count("*").alias("occurrences"),
            F.min("place").alias("place"),
            F.min("severity_rank").alias("severity_rank"),
        )
        .select(
            "capture_id",
            "category",
            severity_name(F.col("severity_rank")).alias("severity"),
            "where",
            F.format_string("entry[%d]", F.expr(f"place div {PER_ENTRY}")).alias("location"),
            "masked_sample",
            "occurrences",
            "severity_rank",
            "place",
        )
    )


def cap(findings: DataFrame, per_category: int = rules.MAX_FINDINGS_PER_CATEGORY) -> DataFrame:
    """Keep the first ``per_category`` distinct findings of each category in reading order.

    The rank limit is applied inside each input partition before the shuffle, so a reducer gets
    at most ``per_category`` rows per category from each partition.
    """
    order = Window.partitionBy("capture_id", "category").orderBy("place")
    return (
        findings.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= per_category)
        .drop("_n")
    )


def scan(entries: DataFrame, per_category: int = rules.MAX_FINDINGS_PER_CATEGORY) -> DataFrame:
    """Findings table of every capture."""
    return cap(roll_up(raw_findings(entries)), per_category)


def scan_files(spark: SparkSession, *paths: str, per_category: int = rules.MAX_FINDINGS_PER_CATEGORY, published: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(findings, captures, rejects)`` of HAR files of any size, or of a folder of published captures."""
    cut = cut_files(spark, *paths, published=published)
    return cut_lineage(scan(entries_of(cut), per_category)), cut.captures, cut.rejects


def report_order(findings: DataFrame) -> DataFrame:
    """Sort rows for reading: capture, severity, category, first place."""
    return findings.orderBy("capture_id", "severity_rank", "category", "place")


def severity_counts(findings: DataFrame, captures: DataFrame) -> DataFrame:
    """Distinct findings per severity for every capture, zeros kept, plus the summary line.

    ``captures`` has one row per capture; captures without findings keep their row.
    """
    counted = findings.groupBy("capture_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITY_RANK]
    )
    zero = {s: 0 for s in rules.SEVERITY_RANK}
    out = captures.join(counted, "capture_id", "left").fillna(zero)
    total = F.col("high") + F.col("medium") + F.col("low")
    tail = " (heuristic — review before publishing)."
    found = F.format_string(
        "security scan: %d high, %d medium, %d low distinct secret/PII finding(s) in the RAW HAR"
        + tail,
        "high",
        "medium",
        "low",
    )
    clean = F.lit("security scan: no obvious secrets/PII detected in the raw HAR" + tail)
    return out.withColumns(
        {
            "has_findings": total > 0,
            "has_high": F.col("high") > 0,
            "summary": F.when(total > 0, found).otherwise(clean),
        }
    )


REPORT_INTRO = (
    "Heuristic scan of the **raw** HAR for secrets/PII. Values are masked. A match is a",
    "candidate to review; a clean result is not a guarantee. This does not affect the",
    "cleaned evidence sent to models.",
)
REPORT_HEAD = (
    "| Severity | Category | Where | Sample (masked) | # | Location |",
    "| --- | --- | --- | --- | --- | --- |",
)


def report_lines(findings: DataFrame, captures: DataFrame) -> DataFrame:
    """Markdown report of every capture as rows; sorting them by ``REPORT_ORDER`` gives the text.

    A report is as long as its capture has findings, so its lines stay rows. ``captures`` has ``capture_id`` and ``source_har``.
    """
    findings = cut_lineage(findings)  # counted and listed
    summary = severity_counts(findings, captures)
    title = F.concat(F.lit("# Security scan — "), F.col("source_har"))
    fixed = [title, F.lit(""), *map(F.lit, REPORT_INTRO), F.lit(""), F.col("summary"), F.lit("")]
    fixed += [F.lit(line) for line in REPORT_HEAD]

    def order(section: Column, rank: Column, category: Column, place: Column) -> list[Column]:
        return [
            section.cast("int").alias("section"),
            rank.cast("int").alias("severity_rank"),
            category.cast("string").alias("category"),
            place.cast(PLACE).alias("place"),
        ]

    null = F.lit(None)
    head = summary.select("capture_id", F.posexplode(F.array(*fixed)).alias("n", "line")).select(
        "capture_id", *order(F.col("n"), null, null, null), "line"
    )
    row = F.format_string(
        "| %s | %s | %s | `%s` | %d | %s |",
        "severity",
        "category",
        "where",
        "masked_sample",
        "occurrences",
        "location",
    )
    ranked = order(F.lit(len(fixed)), F.col("severity_rank"), F.col("category"), F.col("place"))
    return head.unionByName(findings.select("capture_id", *ranked, row.alias("line")))


REPORT_ORDER = ["capture_id", "section", "severity_rank", "category", "place"]
