"""Values past the JSON parser's default length are kept."""

from __future__ import annotations

from callsheet.functions.entry import read_entries
from callsheet.sources.har import explode_entries, normalise_entries, split_valid


def test_large_body_stays(spark):
    body = "x" * 21_000_000
    entry = '{"request":{"method":"GET","url":"http://a.test/"},"response":{"status":200,"content":{"mimeType":"text/plain","text":"' + body + '"}}}'
    captures = spark.createDataFrame([("c", "c.har", '{"log":{"entries":[' + entry + "]}}")], "capture_id string, source_har string, har_text string")
    valid, rejects = split_valid(captures)
    assert rejects.isEmpty()
    lengths = explode_entries(valid).selectExpr("length(entry_json) > 21000000 as long").collect()
    assert [r.long for r in lengths] == [True]
    rows = spark.createDataFrame([("c", 0, entry)], "capture_id string, entry_index long, entry_json string")
    assert read_entries(normalise_entries(rows)).count() == 1
