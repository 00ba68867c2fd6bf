from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import tests.test_runs as this
from callsheet.operators import clean, matrix, outline, prompts, runs
from callsheet.rules import DRY_RUN_TEXT, Provider
from callsheet.sources.runs import export_cells, load_runs, store_runs
from callsheet.sources.templates import available_modes, read_templates, unknown_modes

cloudpickle.register_pickle_by_value(this)
NOW = datetime(2026, 8, 24, 10, 53, 24)
PROVIDERS = [Provider("fake", "claude-fake-1"), Provider("other", "models/o 2")]


def build(name, model):
    def complete(prompt):
        if name == "boom":
            raise RuntimeError("no network")
        return {"text": f"seen {len(prompt)} chars", "input_tokens": 10, "output_tokens": 5, "latency_ms": 1.0}

    return complete


@pytest.fixture
def templates(spark, tmp_path):
    for mode, body in {"minimal": "Look: {{artifact}}", "structured": "A {{artifact}} B {{artifact}}\n", "bare": "no"}.items():
        folder = tmp_path / "templates" / mode
        folder.mkdir(parents=True)
        (folder / "v5.md").write_text(body, encoding="utf-8")
    return read_templates(spark, str(tmp_path / "templates"))


@pytest.fixture
def artifacts(spark):
    rows = [("a", 'x {{artifact}} $1 <script> & é'), ("b", "y")]
    return spark.createDataFrame(rows, "capture_id string, text string").withColumn("chars", F.length("text"))


@pytest.fixture
def captures(spark):
    return spark.createDataFrame([("a", "my shop.pseudo.har"), ("b", "b.har")], "capture_id string, source_har string")


def run(captures, artifacts, templates, providers=PROVIDERS, modes=("minimal", "structured"), dry_run=False):
    table = runs.plan_runs(captures, providers, modes, NOW, dry_run)
    rendered = prompts.render(artifacts, templates, modes, "v5")
    return table, rendered, runs.run(table, rendered, providers, build, len(modes), dry_run)


def test_templates(templates, spark):
    assert [r.mode for r in available_modes(templates).collect()] == ["bare", "minimal", "structured"]
    asked = spark.createDataFrame([("minimal",), ("bogus",)], "mode string")
    assert [r.mode for r in unknown_modes(asked, templates).collect()] == ["bogus"]


def test_render_is_verbatim(artifacts, templates):
    rows = prompts.render(artifacts, templates, ["minimal", "structured"], "v5").collect()
    got = {(r.capture_id, r.mode): (r.prompt, r.prompt_chars) for r in rows}
    text = 'x {{artifact}} $1 <script> & é'
    assert got["a", "structured"][0] == f"A {text} B {text}\n"
    assert all(len(p) == n for p, n in got.values())


def test_prompts_in_pieces_are_the_same_prompts(spark, templates):
    rows = [("a", 1, "{{artifact}} é"), ("a", 0, "x $1 "), ("a", 2**62, None), ("b", -1, "y"), (None, 0, "z")]
    parts = spark.createDataFrame(rows, "capture_id string, part long, text string").repartition(3)
    modes = ["structured", "minimal"]
    want = {(r.capture_id, r.mode, r.mode_pos): (r.prompt_chars, hashlib.md5(r.prompt.encode()).hexdigest()) for r in prompts.render_parts(parts, templates, modes, "v5").collect()}
    pieces = prompts.render_pieces(parts, templates, modes, "v5")
    whole = clean.assemble(pieces, by=("capture_id", "mode", "version", "mode_pos"), digest=True)
    assert {(r.capture_id, r.mode, r.mode_pos): (r.chars, r.digest) for r in whole.collect()} == want and len(want) == 6
    texts = {r.capture_id: (r.chars, hashlib.md5(r.text.encode()).hexdigest()) for r in clean.assemble(parts).collect()}
    assert {r.capture_id: (r.chars, r.digest) for r in clean.assemble(parts, digest=True).collect()} == texts


@pytest.mark.parametrize(("mode", "version", "message"), [("gone", "v5", "Available modes: bare, minimal"), ("minimal", "v9", "version"), ("bare", "v5", "placeholder")])
def test_bad_templates_raise(artifacts, templates, mode, version, message):
    with pytest.raises(ValueError, match=message):
        prompts.render(artifacts, templates, [mode], version)


def test_run_order_identity_and_text(captures, artifacts, templates):
    table, _, responses = run(captures, artifacts, templates)
    ids = {r.capture_id: (r.run_id, r.created_at) for r in table.collect()}
    assert ids["a"] == ("my-shop.pseudo_fake-1+o-2_2026-08-24_12-53-24", "2026-08-24T12:53:24+02:00")
    rows = [r for r in responses.orderBy("run_id", "seq").collect() if r.capture_id == "a"]
    assert [(r.provider, r.mode) for r in rows] == [("fake", "minimal"), ("other", "minimal"), ("fake", "structured"), ("other", "structured")]
    assert all(r.error is None and r.response.text == f"seen {r.prompt_chars} chars" and r.total == 4 for r in rows)
    shown = runs.with_progress(responses).filter("seq = 3").first().progress
    assert shown == "[4/4]"


def test_dry_run_calls_nothing(captures, artifacts, templates):
    _, _, responses = run(captures, artifacts, templates, [Provider("boom", "m")], ("minimal",), dry_run=True)
    assert {(r.response.text, r.error, r.dry_run) for r in responses.collect()} == {(DRY_RUN_TEXT, None, True)}
    assert "Python" not in responses._jdf.queryExecution().executedPlan().toString()


def test_errors_are_rows_and_retry_fixes_them(captures, artifacts, templates, tmp_path, spark):
    providers = [Provider("boom", "m"), Provider("other", "o", max_prompt_chars=10)]
    table, rendered, responses = run(captures, artifacts, templates, providers)
    store_runs(table, responses, str(tmp_path / "store"))
    manifest, stored = load_runs(spark, str(tmp_path / "store"))
    errors = {r.error for r in stored.collect()}
    assert "RuntimeError: no network" in errors and any(e and "exceeds the limit" in e for e in errors)
    assert all(r.response.text == "" for r in stored.filter("error is not null").collect())
    assert {r.errors for r in runs.error_counts(stored).collect()} == {2, 4}
    kept = stored.filter("error is null").collect()
    again = runs.retry(stored, rendered, lambda name, model: lambda prompt: {"text": "fixed", "latency_ms": 2.0})
    rows = again.collect()
    assert len(rows) == 8 and all(r.error is None for r in rows)
    assert {r.seq for r in rows if r.run_id == kept[0].run_id} == {0, 1, 2, 3}
    assert [r.response.text for r in rows if (r.run_id, r.seq) == (kept[0].run_id, kept[0].seq)] == [kept[0].response.text]
    wanted = runs.retry(stored, rendered, lambda n, m: lambda p: {"text": "all"}, should_retry=F.lit(True)).collect()
    assert {r.response.text for r in wanted} == {"all"}
    with pytest.raises(ValueError, match="no such run"):
        load_runs(spark, str(tmp_path / "store"), "absent")
    one, cells = load_runs(spark, str(tmp_path / "store"), manifest.first().run_id)
    assert one.count() == 1 and cells.count() == 4
    export_cells(cells, str(tmp_path / "cells"))
    assert spark.read.json(str(tmp_path / "cells")).count() == 4


@pytest.mark.parametrize("answer", [{"input_tokens": "many"}, {"text": 5}, {"latency_ms": True}, {"output_tokens": 2**40}, ["text"], None])
def test_wrongly_typed_answers_are_errors(answer):
    error, response = runs.call_one(lambda prompt: answer, "p", "m", "hello")
    assert error and response["text"] == "" and response["input_tokens"] is None
    error, response = runs.call_one(lambda prompt: {"text": "a", "latency_ms": 3, "more": 1}, "p", "m", "hello")
    assert error is None and response["latency_ms"] == 3.0 and "more" not in response


def test_unassembled_prompt_becomes_an_error_row(captures, templates, spark):
    big = spark.createDataFrame([("a", None, 10**9), ("b", "y", 1)], "capture_id string, text string, chars long")
    _, rendered, responses = run(captures, big, templates, modes=("minimal",))
    rows = {(r.capture_id, r.provider): r for r in responses.collect()}
    assert rows["a", "fake"].prompt_chars == 10**9 + len("Look: ") and "exceeds" in rows["a", "fake"].error
    assert rows["b", "fake"].error is None


def test_prompts_of_any_length_are_sent(captures, templates, spark):
    parts = spark.createDataFrame([("a", 1, "y" * 2_500_000), ("a", 0, "x" * 2_500_000), ("b", 0, "z")], "capture_id string, part long, text string")
    providers = runs.pick_providers(PROVIDERS, {"fake": "f", "other": "o"})
    table = runs.plan_runs(captures, providers, ["minimal"], NOW)
    rendered = prompts.render_parts(parts, templates, ["minimal"], "v5")
    assert {r.capture_id: (r.prompt_chars, r.prompt[:9], r.prompt[-1]) for r in rendered.collect()} == {"a": (5_000_006, "Look: xxx", "y"), "b": (7, "Look: z", "z")}
    first = runs.run(table, rendered, providers, build, 1).collect()
    assert {(r.prompt_chars, r.error, r.response.text) for r in first} == {(5_000_006, None, "seen 5000006 chars"), (7, None, "seen 7 chars")}


def test_missing_mode_lists_every_known_one(artifacts, spark):
    known = spark.createDataFrame([(f"m{i:03}", "v5", "{{artifact}}") for i in range(60)], "mode string, version string, body string")
    with pytest.raises(ValueError, match="m000, .*m059"):
        prompts.render(artifacts, known, ["gone"], "v5")


def test_providers(spark):
    registry = {"fake": "default-1"}
    assert runs.pick_providers([Provider("fake")], registry)[0].model == "default-1"
    with pytest.raises(ValueError, match="Available: fake"):
        runs.pick_providers([Provider("nope")], registry)
    table = spark.createDataFrame(list(registry.items()), "name string, default_model string")
    asked = runs.requested_providers(spark, [Provider("fake"), Provider("fake", "x"), Provider("nope", "y")])
    assert {(r.name, r.model) for r in runs.resolve_providers(asked, table).collect()} == {("fake", "default-1"), ("fake", "x"), ("nope", "y")}
    assert [r.name for r in runs.unknown_providers(asked, table).collect()] == ["nope"]


@pytest.mark.parametrize(
    ("models", "slug"),
    [(["claude-a b", "claude-a b"], "a-b"), (["models/x", "y", "claude-models/z"], "x+y+z"), (list("abcd"), "4models"), (["//"], "x")],
)
def test_models_slug(spark, models, slug):
    df = spark.createDataFrame([(models,)], "m array<string>")
    assert df.select(runs.models_slug(F.col("m"))).first()[0] == slug


def test_matrix(spark, captures, artifacts, templates):
    table, _, responses = run(captures, artifacts, templates)
    failed = F.when((F.col("seq") == 3), F.lit("RateLimitError: 429 " + "x" * 200))
    shown = responses.withColumn("error", failed).filter("seq <> 2")
    cells = matrix.matrix(table, shown)
    rows = {(r.mode, r.provider): r for r in cells.collect() if r.run_id.startswith("b_")}
    assert rows["minimal", "fake"].meta == "claude-fake-1 · 10/5 tok · 0.0s" and rows["minimal", "fake"].body.startswith("seen ")
    assert rows["structured", "fake"].missing and rows["structured", "fake"].body == "—"
    assert rows["structured", "other"].errored and len(rows["structured", "other"].meta) == len("error: ") + 120
    wide = matrix.pivoted(cells, ["fake", "other"]).collect()
    assert len(wide) == 4 and {c for c in wide[0].asDict()} == {"run_id", "mode_pos", "mode", "fake", "other"}


@pytest.mark.parametrize("ms", [50.0, 250.0, 450.0, 1050.0, 1250.0, 1450.0, 1650.0, 999.0, 60049.9, 2_000_050.0, 0.4])
def test_seconds_round_like_the_binary_value(spark, ms):
    got = spark.createDataFrame([(ms,)], "ms double").select(matrix.seconds(F.col("ms"))).first()[0]
    assert got == f"{ms / 1000:.1f}s"


def test_outline(spark):
    text = "# One\ntext # no\n```py\n# code\n```\n##  Two words \n####### seven\n  ```\n## open fence"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    rows = outline.outline(df, "t", "id").orderBy("position").collect()
    assert [(r.position, r.level, r.title) for r in rows] == [(0, 1, "One"), (1, 2, "Two words ")]
    assert df.select(outline.missing_sections(F.col("t"), ["One", "Two words", "open fence"])).first()[0] == ["open fence"]


def test_answers_leave_a_task_a_few_at_a_time():
    import pandas as pd

    from callsheet.operators import runs

    cells = [{"seq": 0, "total": 1, "provider": "p", "model": "m"}]
    batch = pd.DataFrame([{"run_id": f"r{i}", "mode": "m", "version": "v", "prompt_chars": 1, "prompt": str(i), "cells": cells} for i in range(300)])
    given = list(runs._caller(lambda name, model: lambda prompt: {"text": prompt}, {}, None)(iter([batch, batch[:0]])))
    assert max(map(len, given)) <= 64 and [r["text"] for rows in given for r in rows.response] == [str(i) for i in range(300)]
