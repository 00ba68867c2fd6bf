"""Prompt, run and matrix queries; conversation turns serve as captures, a fixed rule as model."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import callsheet
from callsheet.functions.lineage import shared_folder
from callsheet.functions.slices import spread
from callsheet.functions.text import model_slug, slug
from callsheet.operators import matrix, outline, prompts, runs
from callsheet.plans.query import Query
from callsheet.rules import DRY_RUN_TEXT, VENDOR_PREFIXES, Provider
from callsheet.sources.ledger import Ledger
from callsheet.sources.runs import compact_runs, load_runs, store_runs
from callsheet.sources.templates import available_modes, unknown_modes

# Python workers get the package with the function instead of importing it.
cloudpickle.register_pickle_by_value(callsheet)

NOW = datetime(2026, 7, 1, 22, 30, 5)
MODES = ("minimal", "structured")
VERSION = "v2"
TEMPLATES = {
    ("minimal", "v1"): "Look: {{artifact}}",
    ("minimal", "v2"): "What do you see?\n{{artifact}}\n",
    ("structured", "v2"): "Role: tester.\n<a>{{artifact}}</a>\nAgain: {{artifact}}",
    ("verbose", "v2"): "Tell all about {{artifact}}",
}
REGISTRY = {"alpha": "claude-alpha 1", "beta": "models/beta-2", "gamma": "gamma"}
PROVIDERS = (Provider("alpha"), Provider("beta", "models/beta 9"))


class Refused(Exception):
    """The fixed rule's failure."""


def build(name: str, model: str):
    """A stand-in for a model: answers from the prompt's length, fails on a fixed rule."""

    def complete(prompt: str) -> Mapping[str, Any]:
        n = len(prompt)
        if name == "alpha" and n % 7 == 0:
            raise Refused(f"no answer for {n}")
        if name == "beta" and n > 600:  # this model's own limit: it is called and says so
            raise ValueError(f"prompt of {n} chars exceeds the limit")
        return {
            "text": f"# {name}\nseen {n} chars",
            "input_tokens": n // 4,
            "output_tokens": n % 5,
            "reasoning_tokens": n % 3,
            "latency_ms": float(n * 10),
            "stop_reason": "end",
        }

    return complete


def build_again(name: str, model: str):
    """The second attempt never fails."""
    return lambda prompt: {"text": f"redone {len(prompt)}", "latency_ms": 1.0}


# --- Plans -----------------------------------------------------------------------------------
def _templates(spark) -> DataFrame:
    rows = [(mode, version, body) for (mode, version), body in TEMPLATES.items()]
    return spark.createDataFrame(rows, "mode string, version string, body string")


def _turns(spark, sf_dir) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _artifacts(spark, sf_dir) -> DataFrame:
    capture = F.format_string("%d-%d", "conv_id", "turn")
    return _turns(spark, sf_dir).select(
        capture.alias("capture_id"), F.length("text").alias("chars"), "text"
    )


def _prompts(spark, sf_dir) -> DataFrame:
    return prompts.render(_artifacts(spark, sf_dir), _templates(spark), MODES, VERSION)


def _runs(spark, sf_dir, dry_run: bool = False) -> DataFrame:
    captures = _artifacts(spark, sf_dir).select(
        "capture_id", F.concat(F.lit("turn "), "capture_id", F.lit(".har")).alias("source_har")
    )
    return runs.plan_runs(captures, runs.pick_providers(PROVIDERS, REGISTRY), MODES, NOW, dry_run)


def _responses(spark, sf_dir, dry_run: bool = False, ledger: Ledger | None = None) -> DataFrame:
    return runs.run(
        _runs(spark, sf_dir, dry_run),
        _prompts(spark, sf_dir),
        runs.pick_providers(PROVIDERS, REGISTRY),
        None if dry_run else build,
        len(MODES),
        dry_run,
        ledger=ledger,
    )


def _loaded(spark, sf_dir) -> DataFrame:
    """Responses of calls that were made, with a ledger; stored in two appends, merged, and read back."""
    root = f"{shared_folder(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    table = _runs(spark, sf_dir)
    answers = _responses(spark, sf_dir, ledger=Ledger(f"{root}/ledger"))
    odd = lambda rows: rows.filter(F.pmod(F.xxhash64("run_id"), F.lit(2)) == 1)
    even = lambda rows: rows.filter(F.pmod(F.xxhash64("run_id"), F.lit(2)) == 0)
    store_runs(odd(table), odd(answers), f"{root}/store")
    store_runs(even(table), even(answers), f"{root}/store")
    compact_runs(spark, f"{root}/store", f"{root}/merged")
    manifest, stored = load_runs(spark, f"{root}/merged")
    return _flat(stored.join(manifest.select("run_id"), "run_id", "left_semi"))


def _chosen(spark, sf_dir) -> DataFrame:
    """The caller's own predicate: long prompts are sent again, whether they failed or not."""
    return _flat(runs.retry(_stored(spark, sf_dir), _prompts(spark, sf_dir), build_again, should_retry=F.col("prompt_chars") > 500))


def _flat(responses: DataFrame) -> DataFrame:
    kept = ("run_id", "seq", "total", "provider", "model", "mode", "version", "prompt_chars", "dry_run", "error")
    parts = ("text", "input_tokens", "output_tokens", "reasoning_tokens", "latency_ms", "stop_reason")
    return responses.select(*kept, *[F.col(f"response.{p}").alias(p) for p in parts])


def _stored(spark, sf_dir) -> DataFrame:
    """Responses as a table: answers of the fixed rule written as columns, no Python."""
    n = F.col("prompt_chars")
    providers = runs.pick_providers(PROVIDERS, REGISTRY)
    jobs = _prompts(spark, sf_dir).join(
        _runs(spark, sf_dir).select("run_id", "capture_id"), "capture_id"
    )
    cells = jobs.withColumn("cells", runs._cells(providers, len(MODES))).select(
        "run_id", "capture_id", "mode", "version", "prompt_chars", F.inline("cells")
    )
    refused = (F.col("provider") == "alpha") & (n % 7 == 0)
    refused_text = F.format_string("Refused: no answer for %d", n)
    too_long = (F.col("provider") == "beta") & (n > 600)
    long_text = F.format_string("ValueError: prompt of %d chars exceeds the limit", n)
    error = F.when(refused, refused_text).when(too_long, long_text)
    failed = error.isNotNull()
    answer = F.struct(
        F.col("provider"),
        F.col("model"),
        F.when(failed, "").otherwise(F.format_string("# %s\nseen %d chars", "provider", n)).alias("text"),
        F.when(~failed, F.floor(n / 4).cast("int")).alias("input_tokens"),
        F.when(~failed, (n % 5).cast("int")).alias("output_tokens"),
        F.when(~failed, (n % 3).cast("int")).alias("reasoning_tokens"),
        F.when(failed, F.lit(0.0)).otherwise((n * 10).cast("double")).alias("latency_ms"),
        F.when(~failed, F.lit("end")).alias("stop_reason"),
    )
    return cells.withColumns(
        {"dry_run": F.lit(False), "error": error, "response": answer}
    )


def _thinned(spark, sf_dir) -> DataFrame:
    """Responses with a fixed rule's cells absent, so that the matrix has holes."""
    return _stored(spark, sf_dir).filter((F.col("prompt_chars") + F.col("seq")) % 5 != 0)


def _retried(spark, sf_dir) -> DataFrame:
    return _flat(runs.retry(_stored(spark, sf_dir), _prompts(spark, sf_dir), build_again))


def _backfilled(spark, sf_dir) -> DataFrame:
    stored = _stored(spark, sf_dir)
    redone = stored.filter(runs.errored()).withColumn("error", F.lit(None).cast("string"))
    return runs.backfill(stored, redone).select("run_id", "seq", "provider", "mode", "error")


def _matrix(spark, sf_dir) -> DataFrame:
    return matrix.matrix(_runs(spark, sf_dir), _thinned(spark, sf_dir))


def _latest(spark, sf_dir) -> DataFrame:
    """Two responses per cell; the later one stands."""
    first = _stored(spark, sf_dir)
    second = first.filter(F.col("seq") % 2 == 0).withColumns(
        {"seq": F.col("seq") + 100, "error": F.lit("later")}
    )
    both = matrix.latest(first.unionByName(second))
    return both.select("run_id", "provider", "mode", F.col("cell.error").alias("error"))


def _slugs(spark, sf_dir) -> DataFrame:
    order = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    model = F.concat(
        F.get(F.array(F.lit("claude-"), F.lit("models/"), F.lit("")), (F.col("o_orderkey") % 3).cast("int")),
        "o_orderpriority",
        F.lit(" "),
        "o_orderstatus",
        F.lit("!"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", "model")))
    by_day = order.withColumn("model", model).groupBy(F.col("o_custkey"))
    return by_day.agg(
        runs.models_slug(F.transform(ordered, lambda s: s["model"])).alias("models")
    )


def _model_slug(spark, sf_dir) -> DataFrame:
    parts = spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    model = F.concat(F.lit("claude-models/"), "p_brand", F.lit("  "), "p_name", F.lit("--"))
    return parts.select("p_partkey", slug(F.col("p_type")).alias("plain"), model_slug(model, VENDOR_PREFIXES).alias("model"))


def _run_times(spark, sf_dir) -> DataFrame:
    order = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    utc = F.col("ts").cast("timestamp_ntz")
    source, models = F.concat("event_type", F.lit(" x.y.har")), F.array(F.lit("m/1"), F.lit("m"), F.lit("m"))
    return order.select(
        "event_id", runs.created_at(utc).alias("created_at"), runs.run_id(source, models, utc).alias("run_id")
    )


def _segments(spark, sf_dir) -> DataFrame:
    customer = spread(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    model = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    return customer.select(F.lower("c_mktsegment").alias("name"), model.alias("model"))


def _registry(spark) -> DataFrame:
    rows = [("building", "b-1"), ("machinery", "m-1"), ("household", "h-1")]
    return spark.createDataFrame(rows, "name string, default_model string")


def _marked(spark, sf_dir) -> DataFrame:
    """Turns with headings, one of them inside fenced code."""
    text = F.concat(
        F.lit("# Turn "), "turn", F.lit("\n"), "text", F.lit("\n```\n## not a heading\n```\n##   "), "role",
        F.when(F.col("turn") % 2 == 0, F.lit("\n### Findings\nend")).otherwise("\n####### seven"),
    )
    return _turns(spark, sf_dir).select("conv_id", "turn", text.alias("text"))


def _missing_sections(spark, sf_dir) -> DataFrame:
    lacking = outline.missing_sections(F.col("text"), ["Findings", "user", "Turn 0"])
    return _marked(spark, sf_dir).select("conv_id", "turn", F.array_join(lacking, "|").alias("missing"))


# --- Checking SQL ------------------------------------------------------------------------------
def _template_values() -> str:
    rows = ", ".join(
        f"('{m}', '{v}', '" + body.replace("\n", "' || chr(10) || '") + "')"
        for (m, v), body in TEMPLATES.items()
    )
    return f"(VALUES {rows})"


PROMPTS_CTE = f"""arts AS (SELECT conv_id || '-' || turn AS capture_id, text FROM conversations),
modes AS (SELECT * FROM (VALUES ('minimal', 0), ('structured', 1)) m(mode, mode_pos)),
templates AS (SELECT * FROM {_template_values()} t(mode, version, body)),
prompts AS (SELECT capture_id, mode, version, mode_pos, replace(body, '{{{{artifact}}}}', text) AS prompt
  FROM arts, modes JOIN templates USING (mode) WHERE version = '{VERSION}')"""
RUN_ID = "'turn-' || capture_id || '_alpha-1+beta-9_2026-07-02_00-30-05'"
CELLS_CTE = f"""{PROMPTS_CTE},
cells AS (SELECT *, {RUN_ID} AS run_id, CAST(length(prompt) AS BIGINT) AS n, CAST(mode_pos * 2 + provider_pos AS INTEGER) AS seq
  FROM prompts, (VALUES ('alpha', 'claude-alpha 1', 0), ('beta', 'models/beta 9', 1)) p(provider, model, provider_pos)),
answers AS (SELECT *, CASE WHEN provider = 'alpha' AND n % 7 = 0 THEN 'Refused: no answer for ' || n
    WHEN provider = 'beta' AND n > 600 THEN 'ValueError: prompt of ' || n || ' chars exceeds the limit' END AS error FROM cells),
responses AS (SELECT run_id, seq, 4 AS total, provider, model, mode, version, n AS prompt_chars, false AS dry_run, error,
  CASE WHEN error IS NULL THEN '# ' || provider || chr(10) || 'seen ' || n || ' chars' ELSE '' END AS text,
  CASE WHEN error IS NULL THEN CAST(n // 4 AS INTEGER) END AS input_tokens,
  CASE WHEN error IS NULL THEN CAST(n % 5 AS INTEGER) END AS output_tokens,
  CASE WHEN error IS NULL THEN CAST(n % 3 AS INTEGER) END AS reasoning_tokens,
  CASE WHEN error IS NULL THEN CAST(n * 10 AS DOUBLE) ELSE 0.0 END AS latency_ms,
  CASE WHEN error IS NULL THEN 'end' END AS stop_reason, mode_pos, provider_pos, capture_id FROM answers)"""
FLAT_SQL = "run_id, seq, total, provider, model, mode, version, prompt_chars, dry_run, error, text, input_tokens, output_tokens, reasoning_tokens, latency_ms, stop_reason"
META_SQL = """CASE WHEN error <> '' THEN 'error: ' || substr(error, 1, 120) ELSE concat_ws(' · ', model,
  CASE WHEN coalesce(input_tokens, 0) <> 0 OR coalesce(output_tokens, 0) <> 0 THEN
    CASE WHEN coalesce(input_tokens, 0) = 0 THEN '—' ELSE CAST(input_tokens AS VARCHAR) END || '/' ||
    CASE WHEN coalesce(output_tokens, 0) = 0 THEN '—' ELSE CAST(output_tokens AS VARCHAR) END || ' tok' END,
  CASE WHEN reasoning_tokens <> 0 THEN reasoning_tokens || ' reasoning' END,
  CASE WHEN latency_ms <> 0 THEN printf('%.1fs', latency_ms / 1000.0) END) END"""
MATRIX_SQL = f"""WITH {CELLS_CTE}, kept AS (SELECT * FROM responses WHERE (prompt_chars + seq) % 5 <> 0)
SELECT c.run_id, CAST(c.mode_pos AS INTEGER) AS mode_pos, c.mode, CAST(c.provider_pos AS INTEGER) AS provider_pos, c.provider,
  CASE WHEN k.run_id IS NULL THEN '' ELSE {META_SQL.replace("model,", "k.model,", 1)} END AS meta,
  CASE WHEN k.run_id IS NULL OR k.text = '' THEN '—' ELSE k.text END AS body,
  coalesce(k.error <> '', false) AS errored, k.run_id IS NULL AS missing
FROM cells c LEFT JOIN kept k USING (run_id, mode, provider)"""
SLUG = "coalesce(nullif(trim(regexp_replace({m}, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), 'x')"


def _model_slug_sql(m: str) -> str:
    once = f"regexp_replace({m}, '^claude-', '')"
    return SLUG.format(m=f"regexp_replace({once}, '^models/', '')")


SLUGS_SQL = f"""WITH m AS (SELECT o_custkey, o_orderkey, {_model_slug_sql(
    "(CASE o_orderkey % 3 WHEN 0 THEN 'claude-' WHEN 1 THEN 'models/' ELSE '' END || o_orderpriority || ' ' || o_orderstatus || '!')"
)} AS s FROM orders),
f AS (SELECT o_custkey, s, min(o_orderkey) AS first FROM m GROUP BY ALL)
SELECT o_custkey, CASE WHEN count(*) <= 3 THEN string_agg(s, '+' ORDER BY first) ELSE count(*) || 'models' END AS models
FROM f GROUP BY o_custkey"""
MARKED_SQL = """(SELECT conv_id, turn, role, text, '# Turn ' || turn || chr(10) || text || chr(10) || '```' || chr(10) AS head FROM conversations)"""
OUTLINE_SQL = f"""WITH t AS (SELECT conv_id, turn, role, string_split('# Turn ' || turn || chr(10) || text || chr(10) || '##   ' || role
    || CASE WHEN turn % 2 = 0 THEN chr(10) || '### Findings' ELSE '' END, chr(10)) AS lines FROM conversations),
l AS (SELECT conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM t)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS position,
  CAST(length(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 1)) AS INTEGER) AS level, regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 2) AS title
FROM l WHERE regexp_matches(line, '^(#{{1,6}})\\s+(.*)$')"""
LOCAL = "(ts + INTERVAL 1 HOUR)"  # the events are from January to March, before summer time

QUERIES = {
    "render_prompt": Query(
        _prompts,
        f"""WITH {PROMPTS_CTE} SELECT capture_id, mode, version, CAST(mode_pos AS INTEGER) AS mode_pos,
  CAST(length(prompt) AS BIGINT) AS prompt_chars, prompt FROM prompts""",
    ),
    "run_responses": Query(
        lambda spark, d: _flat(_responses(spark, d)), f"WITH {CELLS_CTE} SELECT {FLAT_SQL} FROM responses"
    ),
    "dry_run": Query(
        lambda spark, d: _flat(_responses(spark, d, dry_run=True)),
        f"""WITH {CELLS_CTE} SELECT run_id, seq, total, provider, model, mode, version, prompt_chars, true AS dry_run,
  CAST(NULL AS VARCHAR) AS error, '{DRY_RUN_TEXT}' AS text, CAST(NULL AS INTEGER) AS input_tokens, CAST(NULL AS INTEGER) AS output_tokens,
  CAST(NULL AS INTEGER) AS reasoning_tokens, CAST(0 AS DOUBLE) AS latency_ms, CAST(NULL AS VARCHAR) AS stop_reason FROM responses""",
    ),
    "run_progress": Query(
        lambda spark, d: runs.with_progress(_stored(spark, d)).select("run_id", "provider", "mode", "progress"),
        f"WITH {CELLS_CTE} SELECT run_id, provider, mode, '[' || (seq + 1) || '/4]' AS progress FROM responses",
    ),
    "run_errors": Query(
        lambda spark, d: runs.error_counts(_stored(spark, d)),
        f"WITH {CELLS_CTE} SELECT run_id, count(error) AS errors, count(*) AS cells FROM responses GROUP BY run_id",
    ),
    "retry_backfill": Query(
        _retried,
        f"""WITH {CELLS_CTE} SELECT run_id, seq, total, provider, model, mode, version, prompt_chars, dry_run, CAST(NULL AS VARCHAR) AS error,
  CASE WHEN error IS NULL THEN text ELSE 'redone ' || prompt_chars END AS text, input_tokens, output_tokens, reasoning_tokens,
  CASE WHEN error IS NULL THEN latency_ms ELSE 1.0 END AS latency_ms, stop_reason FROM responses""",
    ),
    "stored_runs": Query(_loaded, f"WITH {CELLS_CTE} SELECT {FLAT_SQL} FROM responses"),
    "retry_chosen": Query(
        _chosen,
        f"""WITH {CELLS_CTE} SELECT run_id, seq, total, provider, model, mode, version, prompt_chars, dry_run,
  CASE WHEN prompt_chars <= 500 THEN error END AS error, CASE WHEN prompt_chars <= 500 THEN text ELSE 'redone ' || prompt_chars END AS text,
  CASE WHEN prompt_chars <= 500 THEN input_tokens END AS input_tokens, CASE WHEN prompt_chars <= 500 THEN output_tokens END AS output_tokens,
  CASE WHEN prompt_chars <= 500 THEN reasoning_tokens END AS reasoning_tokens, CASE WHEN prompt_chars <= 500 THEN latency_ms ELSE 1.0 END AS latency_ms,
  CASE WHEN prompt_chars <= 500 THEN stop_reason END AS stop_reason FROM responses""",
    ),
    "backfill_by_position": Query(
        _backfilled,
        f"WITH {CELLS_CTE} SELECT run_id, seq, provider, mode, CAST(NULL AS VARCHAR) AS error FROM responses",
    ),
    "run_matrix": Query(_matrix, MATRIX_SQL),
    "missing_cells": Query(
        lambda spark, d: _matrix(spark, d).filter("missing").select("run_id", "mode", "provider"),
        f"SELECT run_id, mode, provider FROM ({MATRIX_SQL}) WHERE missing",
    ),
    "matrix_pivot": Query(
        lambda spark, d: matrix.pivoted(_matrix(spark, d), ["alpha", "beta"]),
        f"""SELECT run_id, mode_pos, mode, max(body) FILTER (provider = 'alpha') AS alpha, max(body) FILTER (provider = 'beta') AS beta
FROM ({MATRIX_SQL}) GROUP BY ALL""",
    ),
    "latest_response": Query(
        _latest,
        f"WITH {CELLS_CTE} SELECT run_id, provider, mode, CASE WHEN seq % 2 = 0 THEN 'later' ELSE error END AS error FROM responses",
    ),
    "model_slug": Query(
        _model_slug,
        f"""SELECT p_partkey, {SLUG.format(m="p_type")} AS plain,
  {_model_slug_sql("('claude-models/' || p_brand || '  ' || p_name || '--')")} AS model FROM part""",
    ),
    "models_slug": Query(_slugs, SLUGS_SQL),
    "run_identity": Query(
        _run_times,
        f"""SELECT event_id, strftime({LOCAL}, '%Y-%m-%dT%H:%M:%S') || '+01:00' AS created_at,
  event_type || '-x.y_m-1+m_' || strftime({LOCAL}, '%Y-%m-%d_%H-%M-%S') AS run_id FROM events""",
    ),
    "provider_models": Query(
        lambda spark, d: runs.resolve_providers(_segments(spark, d), _registry(spark)).groupBy("name", "model").agg(F.count("*").alias("n")),
        """SELECT name, CASE WHEN m <> '' THEN m ELSE CASE name WHEN 'building' THEN 'b-1' WHEN 'machinery' THEN 'm-1' WHEN 'household' THEN 'h-1' END END AS model,
  count(*) AS n FROM (SELECT lower(c_mktsegment) AS name, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name END AS m FROM customer) GROUP BY ALL""",
    ),
    "unknown_providers": Query(
        lambda spark, d: runs.unknown_providers(_segments(spark, d), _registry(spark)),
        "SELECT DISTINCT lower(c_mktsegment) AS name FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery', 'household')",
    ),
    "unknown_modes": Query(
        lambda spark, d: unknown_modes(
            _turns(spark, d).select(F.col("role").alias("mode")),
            _templates(spark).withColumn("mode", F.when(F.col("mode") == "minimal", "user").otherwise(F.col("mode"))),
        ),
        "SELECT DISTINCT role AS mode FROM conversations WHERE role <> 'user'",
    ),
    "available_modes": Query(
        lambda spark, d: available_modes(
            _turns(spark, d).select(F.col("role").alias("mode"), F.lit("v1").alias("version"), F.col("text").alias("body"))
        ),
        "SELECT DISTINCT role AS mode FROM conversations ORDER BY mode",
    ),
    "response_outline": Query(
        lambda spark, d: outline.outline(_marked(spark, d), "text", "conv_id", "turn"), OUTLINE_SQL
    ),
    "missing_sections": Query(
        _missing_sections,
        """SELECT conv_id, turn, concat_ws('|', CASE WHEN turn % 2 = 1 THEN 'Findings' END, CASE WHEN role <> 'user' THEN 'user' END,
  CASE WHEN turn <> 0 THEN 'Turn 0' END) AS missing FROM conversations""",
    ),
}
