"""Runs: providers x modes x captures as one distributed batch, with error rows and retry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime
from numbers import Integral, Real
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet import rules
from callsheet.functions.text import model_slug, slug
from callsheet.schemas import RAW_RESPONSE, RESPONSES
from callsheet.sources.ledger import Ledger

Complete = Callable[[str], Mapping[str, Any]]
Build = Callable[[str, str], Complete]


# --- Providers ------------------------------------------------------------------------------
def resolve_providers(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """``requested(name, model)`` with the registry's ``default_model`` where no model is given."""
    return requested.join(registry, "name", "left").select(
        "name", F.coalesce(F.nullif("model", F.lit("")), "default_model").alias("model")
    )


def unknown_providers(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested names the registry lacks; must be empty before a run."""
    return requested.select("name").distinct().join(registry, "name", "left_anti")


def pick_providers(
    requested: Sequence[rules.Provider], registry: Mapping[str, str]
) -> list[rules.Provider]:
    """Configured providers with their model; an unknown name raises."""
    for provider in requested:
        if provider.name not in registry:
            known = ", ".join(sorted(registry)) or "(none)"
            raise ValueError(f"Unknown provider {provider.name!r}. Available: {known}.")
    return [
        rules.Provider(p.name, p.model or registry[p.name], p.max_prompt_chars) for p in requested
    ]


# --- Run identity -----------------------------------------------------------------------------
def models_slug(models: Column) -> Column:
    """Token for the models of a run: itself, up to three joined by ``+``, else ``Nmodels``."""
    seen = F.array_distinct(F.transform(models, lambda m: model_slug(m, rules.VENDOR_PREFIXES)))
    return F.when(F.size(seen) <= 3, F.array_join(seen, "+")).otherwise(
        F.concat(F.size(seen).cast("string"), F.lit("models"))
    )


def local_time(utc: Column) -> Column:
    """Wall-clock time of a run for a zone-less UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(rules.RUN_TIME_ZONE), utc)


def created_at(utc: Column) -> Column:
    """ISO seconds with offset, whatever the session's time zone is."""
    local = local_time(utc)
    minutes = F.timestamp_diff("MINUTE", utc, local)
    return F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(minutes < 0, F.lit("-")).otherwise("+"),
        F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60),
    )


def run_id(source: Column, models: Column, utc: Column) -> Column:
    """``<file stem>_<models>_<local time>``."""
    stem = F.regexp_replace(source, r"(?s)(?<=.)\.[^.]*$", "")
    stamp = F.date_format(local_time(utc), "yyyy-MM-dd_HH-mm-ss")
    return F.concat_ws("_", slug(stem), models_slug(models), stamp)


def plan_runs(
    captures: DataFrame,
    providers: Sequence[rules.Provider],
    modes: Sequence[str],
    now_utc: datetime,
    dry_run: bool = False,
) -> DataFrame:
    """One run row per capture."""
    utc = F.lit(now_utc.replace(tzinfo=None)).cast("timestamp_ntz")
    models = F.array(*[F.lit(p.model) for p in providers])
    return captures.select(
        run_id(F.col("source_har"), models, utc).alias("run_id"),
        "capture_id",
        F.col("source_har").alias("fixture"),
        created_at(utc).alias("created_at"),
        F.lit(dry_run).alias("dry_run"),
        F.array(*[F.lit(p.name) for p in providers]).alias("providers"),
        F.array(*[F.lit(m) for m in modes]).alias("modes"),
    )


# --- Calls ------------------------------------------------------------------------------------
def _checked(name: str, kind: T.DataType, value: Any) -> Any:
    """``value`` if it fits the field's type, which an answer of another type must not pass."""
    fits = {T.StringType: str, T.IntegerType: Integral, T.DoubleType: Real}[type(kind)]
    if value is None:
        return None
    if not isinstance(value, fits) or isinstance(value, bool):
        raise TypeError(f"{name} must be {kind.simpleString()}, not {type(value).__name__}")
    if fits is Integral and not -(2**31) <= value < 2**31:
        raise ValueError(f"{name} is out of range")
    return {str: str, Integral: int, Real: float}[fits](value)


def call_one(complete: Complete, name: str, model: str, prompt: str) -> tuple[str | None, dict]:
    """One stateless call; a failure becomes an error text and an empty response."""
    blank = dict.fromkeys(RAW_RESPONSE.fieldNames()) | {"provider": name, "model": model}
    try:
        answer = blank | {"latency_ms": 0.0} | dict(complete(prompt))
        return None, {f.name: _checked(f.name, f.dataType, answer[f.name]) for f in RAW_RESPONSE}
    except Exception as exc:  # one failing call must not sink the batch
        return f"{type(exc).__name__}: {exc}", blank | {"text": "", "latency_ms": 0.0}


#: Jobs whose prompts and answers a task holds beside the batch that Spark gives it.
AT_ONCE = 64


def _caller(build: Build, limits: dict[str, int], ledger: Ledger | None):
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[tuple[str, str], Complete] = {}
        few = (batch.iloc[i : i + AT_ONCE] for batch in batches for i in range(0, len(batch), AT_ONCE))
        for rows in few:
            out = []
            for row in rows.to_dict("records"):
                prompt, cells = row.pop("prompt"), row.pop("cells")
                for cell in cells:
                    name, model = cell["provider"], cell["model"]
                    place = row | {k: cell[k] for k in ("seq", "total", "provider", "model")} | {"dry_run": False}
                    known = ledger.find(row["run_id"], cell["seq"]) if ledger else None
                    if known:
                        out.append(place | {"error": known[0], "response": known[1]})
                        continue
                    limit = limits.get(name, 0)
                    if prompt is None or 0 < limit < row["prompt_chars"]:

                        def complete(_: str, n=row["prompt_chars"]) -> Mapping[str, Any]:
                            raise ValueError(f"prompt of {n} chars exceeds the limit")

                    else:
                        if (name, model) not in ready:
                            ready[name, model] = build(name, model)
                        complete = ready[name, model]
                    error, response = call_one(complete, name, model, prompt)
                    if ledger:
                        ledger.keep(row["run_id"], cell["seq"], error, response)
                    out.append(place | {"error": error, "response": response})
            yield pd.DataFrame(out, columns=RESPONSES.fieldNames())

    return call


def _answer(jobs: DataFrame, build: Build, limits: dict[str, int], partitions: int | None, ledger: Ledger | None = None) -> DataFrame:
    """Call every cell of ``jobs``; each prompt travels once for all its providers."""
    keys = ["capture_id", "mode"]
    spread = jobs.repartition(partitions, *keys) if partitions else jobs.repartition(*keys)
    return spread.mapInPandas(_caller(build, limits, ledger), RESPONSES)


def _cells(providers: Sequence[rules.Provider], n_modes: int) -> Column:
    n = len(providers)
    return F.array(
        *[
            F.struct(
                (F.col("mode_pos") * n + i).cast("int").alias("seq"),
                F.lit(n_modes * n).alias("total"),
                F.lit(p.name).alias("provider"),
                F.lit(p.model).alias("model"),
            )
            for i, p in enumerate(providers)
        ]
    )


JOB = ["run_id", "capture_id", "mode", "version", "prompt_chars", "prompt", "cells"]


def run(
    runs: DataFrame,
    prompts: DataFrame,
    providers: Sequence[rules.Provider],
    build: Build | None,
    n_modes: int,
    dry_run: bool = False,
    partitions: int | None = None,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Responses of every (capture, mode, provider).

    The calls happen whenever the result is computed: pass it to ``store_runs`` once and go on
    with what ``load_runs`` returns. With a ``ledger`` each cell is called for once, however often
    tasks or the whole run are started again. A dry run plans no Python at all.
    """
    jobs = (
        prompts.join(runs.select("run_id", "capture_id"), "capture_id")
        .withColumn("cells", _cells(providers, n_modes))
        .select(*JOB)
    )
    if not dry_run:
        limits = {p.name: p.max_prompt_chars for p in providers}
        return _answer(jobs, build, limits, partitions, ledger)
    cells = jobs.select(*JOB[:5], F.inline("cells"))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in RAW_RESPONSE.fields}
    blank |= {
        "provider": F.col("provider"),
        "model": F.col("model"),
        "text": F.lit(rules.DRY_RUN_TEXT),
        "latency_ms": F.lit(0.0),
    }
    return cells.withColumns(
        {
            "dry_run": F.lit(True),
            "error": F.lit(None).cast("string"),
            "response": F.struct(*[v.alias(k) for k, v in blank.items()]),
        }
    ).select(*RESPONSES.fieldNames())


def errored(error: Column | None = None) -> Column:
    """Default retry predicate: a non-empty error."""
    error = F.col("error") if error is None else error
    return F.coalesce(error != "", F.lit(False))


def retry(
    responses: DataFrame,
    prompts: DataFrame,
    build: Build,
    should_retry: Column | None = None,
    limits: dict[str, int] | None = None,
    partitions: int | None = None,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Redo the selected cells and put them back at their place; the others stay as they are.

    Every prompt is sent again. A run whose caller bounded a provider's prompts is redone under the
    same bounds only if ``limits`` names them. A ``ledger`` needs an attempt of its own.
    """
    chosen = F.coalesce(errored() if should_retry is None else should_retry, F.lit(False))
    cell = F.struct("seq", "total", "provider", "model").alias("c")
    again = (
        responses.filter(chosen)
        .groupBy("run_id", "capture_id", "mode", "version")
        .agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        .join(prompts.select("capture_id", "mode", "version", "prompt_chars", "prompt"), ["capture_id", "mode", "version"])
        .select(*JOB)
    )
    redone = _answer(again, build, limits or {}, partitions, ledger)
    return responses.filter(~chosen).unionByName(redone)


def backfill(original: DataFrame, redone: DataFrame) -> DataFrame:
    """Replace cells of ``original`` by their redone version, matched on (run_id, seq)."""
    keys = ["run_id", "seq"]
    return original.join(redone.select(*keys), keys, "left_anti").unionByName(redone)


def error_counts(responses: DataFrame) -> DataFrame:
    """Errored cells per run."""
    return responses.groupBy("run_id").agg(
        F.count_if(errored()).alias("errors"), F.count("*").alias("cells")
    )


def with_progress(responses: DataFrame) -> DataFrame:
    """1-based position text ``[i/total]`` of every cell."""
    return responses.withColumn(
        "progress", F.format_string("[%d/%d]", F.col("seq") + 1, F.col("total"))
    )


def requested_providers(spark: SparkSession, providers: Sequence[rules.Provider]) -> DataFrame:
    return spark.createDataFrame([(p.name, p.model) for p in providers], "name string, model string")
