"""Prompt rendering at (capture, mode) grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.functions.text import occurrences
from callsheet.operators.clean import assemble
from callsheet.rules import ARTIFACT_PLACEHOLDER
from callsheet.sources.templates import size_checked


def mode_rows(modes: Sequence[str], version: str):
    """Requested modes as an array of ``struct(mode, version, mode_pos)`` literals."""
    return F.array(
        *[
            F.struct(
                F.lit(mode).alias("mode"),
                F.lit(version).alias("version"),
                F.lit(i).alias("mode_pos"),
            )
            for i, mode in enumerate(modes)
        ]
    )


def check_templates(templates: DataFrame, modes: Sequence[str], version: str) -> None:
    """Raise when a requested (mode, version) has no template or no placeholder."""
    found = {
        row.mode: row.ok
        for row in templates.filter((F.col("version") == version) & F.col("mode").isin(*modes))
        .select("mode", F.contains("body", F.lit(ARTIFACT_PLACEHOLDER)).alias("ok"))
        .limit(len(modes) + 1)
        .collect()
    }
    for mode in modes:
        if mode not in found:
            known = templates.select("mode").distinct().orderBy("mode").collect()
            listed = ", ".join(row.mode for row in known) or "(none)"
            raise ValueError(
                f"No prompt template for mode={mode!r} version={version!r}. Available modes: {listed}."
            )
        if not found[mode]:
            raise ValueError(
                f"Template {mode}/{version} is missing the {ARTIFACT_PLACEHOLDER} placeholder."
            )


def _literal(text: str) -> str:
    return f"\\Q{text}\\E"


def render(artifacts: DataFrame, templates: DataFrame, modes: Sequence[str], version: str) -> DataFrame:
    """Prompts ``(capture_id, mode, version, mode_pos, prompt_chars, prompt)``.

    ``artifacts`` is ``(capture_id, chars, text)`` from ``assemble``. The prompt is rendered once
    per mode and shared by all providers. ``prompt_chars`` is exact even where ``text`` is null
    because the capture is too big to be one string; ``prompt`` is null there.
    """
    check_templates(templates, modes, version)
    wanted = artifacts.select("*", F.inline(mode_rows(modes, version)))
    joined = wanted.join(size_checked(templates), ["mode", "version"])
    times = occurrences(F.col("body"), F.lit(ARTIFACT_PLACEHOLDER))
    growth = times * (F.col("chars") - len(ARTIFACT_PLACEHOLDER))
    return joined.select(
        "capture_id",
        "mode",
        "version",
        "mode_pos",
        (F.length("body") + growth).cast("bigint").alias("prompt_chars"),
        F.replace("body", F.lit(ARTIFACT_PLACEHOLDER), "text").alias("prompt"),
    )


def render_pieces(parts: DataFrame, templates: DataFrame, modes: Sequence[str], version: str) -> DataFrame:
    """The prompts of ``render`` as ordered pieces ``(capture_id, mode, version, mode_pos, piece, part, text)``.

    ``parts`` are artifact parts. A template is cut at its placeholders; its pieces and the artifact's
    parts alternate, so that prompts may be larger than any string. A mode and version has one template.
    """
    check_templates(templates, modes, version)
    known = size_checked(templates.select("mode", "version", F.split("body", _literal(ARTIFACT_PLACEHOLDER), -1).alias("_own")), "_own")
    wanted = parts.select("capture_id", "part", "text", F.inline(mode_rows(modes, version))).join(known, ["mode", "version"])
    columns = ["capture_id", "mode", "version", "mode_pos"]
    # of n pieces, the artifact follows each but the last
    gaps = F.explode(F.sequence(F.lit(2), 2 * (F.size("_own") - 1), F.lit(2)))
    inside = wanted.select(*columns, gaps.alias("piece"), "part", "text")
    captures = parts.select("capture_id").distinct().select("capture_id", F.inline(mode_rows(modes, version))).join(known, ["mode", "version"])
    around = captures.select(*columns, F.posexplode("_own").alias("piece", "text"))
    fixed = around.select(*columns, (2 * F.col("piece") + 1).alias("piece"), F.lit(None).cast(parts.schema["part"].dataType).alias("part"), "text")
    return inside.unionByName(fixed)


def render_parts(parts: DataFrame, templates: DataFrame, modes: Sequence[str], version: str, max_chars: int | None = None) -> DataFrame:
    """Prompts straight from artifact parts; see ``render``."""
    return render(assemble(parts, max_chars), templates, modes, version)
