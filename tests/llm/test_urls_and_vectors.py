"""Hosts, hot keys and repeated captures of the URL filter; vectors too large to score."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.llm import topk, urlfilter

DAY = datetime.date


def test_hosts_and_lookup_keys(spark):
    cases = {
        "http://a@b@evil.com/": ("evil.com", ["evil.com", "evil.com/"]),
        "http://user:pw@WWW.Evil.com.:8080?x=@y": ("www.evil.com", ["www.evil.com", "evil.com"]),
        "http://[2001:db8::1]:80/x": ("[2001:db8::1]", ["[2001:db8::1]", "[2001:db8::1]/x"]),
        "https://192.168.2.1/a/b": ("192.168.2.1", ["192.168.2.1", "192.168.2.1/a/", "192.168.2.1/a/b"]),
        "http://1.2.3.4.example.org": ("1.2.3.4.example.org", ["1.2.3.4.example.org", "2.3.4.example.org", "3.4.example.org", "4.example.org", "example.org"]),
        "http://u@/p": ("", []),
        "no url": ("", []),
        None: (None, []),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    for r in rows.select("url", urlfilter.host_of(F.col("url")).alias("h"), urlfilter.lookup_keys(F.col("url")).alias("k")).collect():
        host, keys = cases[r.url]
        assert r.h == host and sorted(r.k) == sorted(set(keys)), r.url


def test_repeated_captures_clashing_columns_and_long_urls(spark):
    captures = [(i, f"http://hot.example/{i % 3}/", DAY(2024, 1, 1 + i % 4), "x", 1) for i in range(400)] + [(7, "http://hot.example/1/", DAY(2024, 1, 4), "x", 1)] * 3
    captures += [(900, "http://hot.example/" + "a/" * 4000, DAY(2024, 1, 9), "x", 1), (None, "http://hot.example/", DAY(2024, 1, 9), "x", 1), (901, "http://hot.example/", None, "x", 1)]
    table = spark.createDataFrame(captures, "capture_id long, url string, fetched date, key string, n_matches int").repartition(5)
    entries = spark.createDataFrame([("l", "add", "HOT.example.", DAY(2024, 1, 2)), ("l", "remove", "hot.example", DAY(2024, 1, 3)), ("m", "add", "hot.example/1/", DAY(2024, 1, 1)), ("m", "add", "hot.example/a/a/", DAY(2024, 1, 1))], "list string, action string, key string, dated date")
    got = sorted(((r.capture_id, r.fetched, r.lists, r.n_matches, r.reason) for r in urlfilter.verdicts(table, entries).collect()), key=str)
    want = []
    by_id = {}
    for i, url, day, *_ in captures:
        found = {("l", "hot.example")} if day == DAY(2024, 1, 2) else set()
        if day and url.startswith("http://hot.example/1/"):
            found = found | {("m", "hot.example/1/")}
        if day and url.startswith("http://hot.example/a/a/"):
            found = found | {("m", "hot.example/a/a/")}
        by_id.setdefault(i, set()).update(found if i is not None else ())
    for i, _, day, *_ in captures:
        found = by_id[i]
        want.append((i, day, ",".join(sorted({x for x, _ in found})), len(found), min((k for _, k in found), key=lambda k: (-len(k), k), default="")))
    assert got == sorted(want, key=str)


def test_vectors_beyond_a_long_fail_clearly(spark):
    make = lambda v: spark.createDataFrame([(0, [1.0, 2.0]), (1, v)], "vec_id long, embedding array<double>")
    for v in ([3e9, 1.0], [1.5e6, -1.6e6]):
        with pytest.raises(Exception, match="too large for scores"):
            topk.search(make(v), F.lit(True)).collect()
    assert topk.search(make([float("inf"), 1.0]), F.lit(True)).collect() == []


def test_one_bit_of_padding_is_packed_and_searched(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-900, 900, (127, 5))
    index = topk.build(np.arange(127), vectors)  # one bit of padding
    for own in (0, 77):
        ids, scores = topk.select(index, vectors[own], own, 4)
        want = sorted((-int(vectors[own] @ vectors[i]), i) for i in range(127) if i != own)[:4]
        assert sorted(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
    table = spark.createDataFrame([(i, [float(x) / 1024 for x in v]) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.score for r in topk.search(table, F.col("vec_id") == 77, 4).collect()}
    assert [got[77, r] for r in range(1, 5)] == [-s for s, _ in want]
