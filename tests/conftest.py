from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from callsheet.sources.har import normalise_entries  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("callsheet-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("lineage")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def entries(spark):
    """Entry rows from ``{capture: [entry, ...]}``."""

    def make(captures: dict[str, list], partitions: int = 3):
        rows = [(c, i, json.dumps(e, ensure_ascii=False)) for c, es in captures.items() for i, e in enumerate(es)]
        schema = "capture_id string, entry_index long, entry_json string"
        return normalise_entries(spark.createDataFrame(rows, schema).repartition(partitions))

    return make


@pytest.fixture
def har_file(tmp_path):
    """Write a HAR file and return its path."""

    def write(name: str, content) -> str:
        path = tmp_path / name
        path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
        return str(path)

    return write
