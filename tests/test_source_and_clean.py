from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from callsheet.functions.entry import read_entries
from callsheet.functions.jsontext import is_json
from callsheet.functions.text import human_size
from callsheet.operators import clean
from callsheet.rules import CleanRules
from callsheet.sources.har import explode_entries, normalise_entries, normalise_rejects, read_har, split_valid
from tests.samples import call, shop


def cleaned(df, rules=CleanRules()):
    rows = clean.preprocess(df, rules).orderBy("capture_id", "entry_index").collect()
    return {row.url: row for row in rows}


def test_har_files_and_rejects(spark, har_file, tmp_path):
    har_file("a.har", {"log": {"entries": [shop()[0], 5, "x", shop()[5]]}})
    har_file("b.har", '{"log": {"entries": []}} trailing')
    har_file("c.har", "[1]")
    har_file("d.har", {"log": []})
    valid, rejects = split_valid(read_har(spark, str(tmp_path)))
    assert {r.source_har for r in rejects.collect()} == {"b.har", "c.har"}
    rows = explode_entries(valid).orderBy("entry_index").collect()
    assert [r.entry_index for r in rows] == [0, 3]
    totals = clean.capture_totals(valid, explode_entries(valid), clean.preprocess(explode_entries(valid)))
    assert {r.source_har: r.total_entries for r in totals.collect()} == {"a.har": 2, "d.har": 0}


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        ('{"a":1}', True), ('{"a":1} x', False), ("1,2", False), ("{},{}", False), ("{'a':1}", False),
        ("null", True), ("NaN", True), (" ", False), ("01", False), ("[1,]", False), (".5", False),
        ('{"a":1}]', False), ("1}", False), ("1]}", False), ('"a\nb"', False), ('{"a":1,"a":2}', True),
        (' [1, "x"] ', True), ('"s"', True),
    ],
)
def test_strict_json(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(is_json(F.col("t"))).first()[0] is ok


def test_envelopes_and_bodies(entries):
    calls = cleaned(entries({"c": shop()}))
    assert list(calls) == [e["request"]["url"] for e in shop()]
    users = calls["https://api.bikes.test/v2/rides"]
    assert json.loads(users.response_body)["total"] == 1 and users.response_body_kind == "object"
    assert users.response_headers == {"content-security-policy": "default-src 'self'", "cache-control": "no-cache"}
    assert (users.status, users.time_ms, users.response_content_type) == (200, 17.25, "application/json")
    assert calls["https://img.bikes.test/frame.png"].response_body == "<stripped: image/png>"
    assert calls["https://img.bikes.test/type.woff2"].response_body is None
    assert calls["https://www.bikes.test/app.js"].response_body == "<stripped: application/javascript, 18 B>"
    login = calls["https://api.bikes.test/v2/session"]
    assert login.request_headers == {"authorization": "<redacted>"}
    assert login.response_headers["set-cookie"] == "<redacted>"
    assert json.loads(login.request_body)["email"] == "rider@bikes.test"


def test_oversized_and_bodyless(entries):
    big, small = json.dumps({"b": "x" * 30000}), '{"ok": true}'
    cases = [
        call("GET", "big", mime="application/json", text=big),
        call("GET", "small", mime="application/json", text=small),
        call("GET", "n304", 304, "image/png", "cached", size=58000),
        call("POST", "n204", 204, "image/png", "cached"),
        call("HEAD", "head", 200, "image/png", "cached"),
        call("GET", "n101", 101, "image/png", "cached"),
        call("GET", "real", 200, "image/png", "cached", size=58000),
        call("GET", "broken", mime="application/json", text="{oops"),
        call("GET", "nothing", mime="application/json", text="null"),
        call("GET", "scalar", mime="application/json", text=' "a\\u00e9" '),
        call("GET", "odd", mime="application/json", text={"not": "a string"}),
    ]
    calls = cleaned(entries({"c": cases}))
    assert calls["big"].response_body == "<stripped: application/json, 29 KB (oversized)>"
    assert calls["small"].response_body == '{"ok":true}'
    assert all(calls[u].response_body is None for u in ("n304", "n204", "head", "n101", "nothing", "odd"))
    assert calls["real"].response_body == "<stripped: image/png, 57 KB>"
    assert calls["broken"].response_body == "<stripped: application/json, 5 B>"
    assert calls["scalar"].response_body == '"aé"' and calls["scalar"].response_body_kind == "scalar"


def test_junk_shapes(entries):
    odd = [
        {"request": "bad", "response": {}},
        {"request": "bad", "response": {}, "x": {"request": {"url": "deep"}}},
        {"request": {"url": "a", "headers": "no"}, "response": {"status": None, "headers": [5, {"name": "Server", "value": 7}, {}]}},
        {"request": {"url": "b"}, "response": {"status": "200"}, "time": "12", "startedDateTime": 5},
        {"request": {"url": "c"}, "response": {"status": "soon"}},
        {"request": {"url": "d", "method": "GET"}, "response": {"status": 200.7, "headers": [{"name": "server", "value": "1"}, {"name": ":Server", "value": "2"}]}},
    ]
    df = entries({"c": odd})
    calls, rejects = clean.split_calls(clean.envelopes(df))
    found = {r.url: r for r in calls.collect()}
    assert set(found) == {"a", "b", "d"}
    assert found["a"].status == 0 and found["a"].response_headers == {"server": "7"}
    assert found["b"].status == 200 and found["b"].time_ms is None and found["b"].started_at is None
    assert found["d"].status == 200 and found["d"].response_headers == {"server": "1"}
    assert [r.entry_index for r in rejects.collect()] == [4]


def test_values_are_told_by_their_json_type(spark, entries, har_file, tmp_path):
    """Strings that look like objects are none, and nested namesakes do not lend their type."""
    inner = json.dumps({"request": {"url": "inner"}, "response": {}})
    header = json.dumps({"name": "Server", "value": "fake"})
    odd = {
        "startedDateTime": 5,
        "request": {"url": "u", "headers": [header, {"name": "Server", "value": "real"}], "x": {"headers": "h", "startedDateTime": "no"}},
        "response": {"status": 200, "content": {"mimeType": 7, "text": {"a": 1}, "x": {"mimeType": "text/plain", "text": "no"}}},
    }
    har_file("t.har", {"log": {"entries": [odd, inner, 5, {"request": inner, "response": {"request": {}}}]}})
    rows = explode_entries(read_har(spark, str(tmp_path))).orderBy("entry_index")
    assert [r.entry_index for r in rows.collect()] == [0, 3]
    first, second = read_entries(rows).orderBy("entry_index").collect()
    assert first.started_at is None and first.response_content.mime is None and first.response_content.text is None
    assert [(h.name, h.value) for h in first.request_headers] == [("Server", "real")]
    assert second.url == ""
    loose = spark.createDataFrame([("c", 0, json.dumps(inner)), ("c", 1, " " + inner), ("c", 2, None), ("c", 3, "{oops")], "capture_id string, entry_index long, entry_json string")
    assert [r.entry_index for r in normalise_entries(loose).collect()] == [1]
    assert {r.entry_index for r in normalise_rejects(loose).collect()} == {0, 2, 3}


def test_url_exclusion_and_custom_rules(entries):
    df = entries({"c": shop()})
    assert not [u for u in cleaned(df, CleanRules(exclude_url_substrings=("img.bikes.test",))) if "img" in u]
    assert len(cleaned(df, CleanRules(exclude_url_substrings=("IMG",)))) == 6
    plain = cleaned(df, CleanRules(json_markers=("plain",), max_body_chars=1))
    assert plain["https://api.bikes.test/ping"].response_body == "<stripped: text/plain, 2 B (oversized)>"


def test_artifact_is_valid_stable_json(entries, spark):
    captures = spark.createDataFrame([("c", "c.har"), ("none", "none.har")], "capture_id string, source_har string")
    texts = []
    for partitions in (1, 8):
        df = entries({"c": shop()}, partitions)
        calls = clean.preprocess(df)
        totals = clean.capture_totals(captures, df, calls)
        parts = clean.artifact_parts(totals, calls)
        texts.append({r.capture_id: r.text for r in clean.assemble(parts, 10**6).collect()})
    assert texts[0] == texts[1]
    artifact = json.loads(texts[0]["c"])
    assert list(artifact) == ["source_har", "total_entries", "calls", "json_body_count"]
    assert (artifact["total_entries"], len(artifact["calls"]), artifact["json_body_count"]) == (6, 6, 2)
    assert artifact["calls"][0]["response_body"] == {"rides": [{"no": 7, "km": 12}], "total": 1}
    assert artifact["calls"][2]["response_body"] is None and list(artifact["calls"][0]) == clean.CALL
    assert json.loads(texts[0]["none"])["calls"] == []
    small = {r.capture_id: (r.chars, r.text) for r in clean.assemble(parts, 100).collect()}
    assert small["c"] == (len(texts[0]["c"]), None) and small["none"][1] is not None


@pytest.mark.parametrize(
    ("n", "label"),
    [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (2560, "2 KB"), (3584, "4 KB"), (1048576, "1.0 MB"), (1310720, "1.2 MB")],
)
def test_human_size(spark, n, label):
    assert spark.createDataFrame([(n,)], "n long").select(human_size(F.col("n"))).first()[0] == label


def test_each_entry_is_parsed_once(entries):
    """No predicate on a parsed column may be pushed below the parse."""
    plan = clean.preprocess(entries({"c": shop()}))._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert not any("url string" in line or "StructField(url" in line for line in filters)
    assert read_entries(entries({"c": shop()})).count() == 6


def test_a_small_file_of_many_rows_is_many_tasks(spark, tmp_path, monkeypatch):
    from callsheet.functions import slices

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(slices, "ROWS_PER_TASK", 100)
    rows = slices.spread(spark.read.parquet(str(tmp_path / "t")))
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 1000
