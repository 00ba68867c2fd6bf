"""Large groups of near copies in the Jaccard join, and passages of over 50 words in the suffix operator."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.functions.lineage import CLEANUP, cut_lineage, discard, shared_folder
from callsheet.llm import jaccard, suffix
from callsheet.llm.graph import components

DOCS = "doc_id long, text string, n_chars long, label long, row_marks string"


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def changed(rng, words, n=1):
    words = list(words)
    for at in rng.sample(range(5, len(words) - 5), n):
        words[at] = words_of(rng, 1)[0] + "x"
    return words


def by_matrix(rows):
    """Components by the product of the whole incidence matrix."""
    sets = []
    for _, text in rows:
        words = text.split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    place = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    grid = np.zeros((len(rows), len(place)), np.float32)
    for i, own in enumerate(sets):
        grid[i, [place[s] for s in own]] = 1
    both = grid @ grid.T
    size = grid.sum(axis=1)
    link = (100 * both >= 80 * (size[:, None] + size[None, :] - both)) & (both > 0)
    root = np.arange(len(rows))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(rows)).min(axis=1, initial=len(rows)))
        new = new[new]
        if (new == root).all():
            break
        root = new
    ids = np.array([i for i, _ in rows])
    least = [int(ids[root == r].min()) for r in root]
    return Counter((i, len(s), c if s else i) for (i, _), s, c in zip(rows, sets, least, strict=True))


@pytest.fixture
def table(spark):
    return lambda rows, parts=4: spark.createDataFrame([(i, t, 0, 7, "m") for i, t in rows], DOCS).repartition(parts)


@pytest.mark.parametrize("limits", [(64, 1 << 18, 1024), (2, 40, 16)])
def test_chains_stars_and_common_passages_match_the_whole_matrix(table, monkeypatch, limits):
    for name, limit in zip(("PAIRED", "HELD", "BLOCK"), limits, strict=True):
        monkeypatch.setattr(jaccard, name, limit)
    rng = random.Random(21)
    rows = []
    star = words_of(rng, 70)
    rows += [(1000 + i, " ".join(changed(rng, star))) for i in range(150)] + [(5000, " ".join(star))]
    orphan = words_of(rng, 70)  # copies without the text that they were made from
    rows += [(2000 + i, " ".join(changed(rng, orphan, rng.randint(1, 2)))) for i in range(80)]
    link = words_of(rng, 70)
    for i in range(60):  # each is close to the one before it only
        link = changed(rng, link)
        rows.append((3000 + i, " ".join(link)))
    shared = words_of(rng, 20)
    rows += [(4000 + i, " ".join(words_of(rng, 12) + shared + words_of(rng, 12))) for i in range(90)]
    rows += [(6000 + i, " ".join(words_of(rng, 30))) for i in range(40)]
    rng.shuffle(rows)
    got = Counter(tuple(r) for r in jaccard.score(table(rows)).collect())
    assert got == by_matrix(rows)


def test_thousands_of_near_copies_meet_their_hub_only(spark, table):
    rng = random.Random(22)
    base = words_of(rng, 80)
    rows = [(i, " ".join(changed(rng, base))) for i in range(1, 5000)] + [(9999, " ".join(base))]
    docs = table(rows)
    assert {r.component_id for r in jaccard.score(docs).collect()} == {1}
    measured = jaccard.measured(docs)
    met = jaccard.lists(jaccard.prefixes(docs, jaccard.common_shingles(measured)))
    near = jaccard.families(met)
    assert near.count() > 4900 and near.select("label").distinct().count() < 50
    texts = measured.where("kind = 0").join(docs, "doc_id").selectExpr("class", "text")
    links = jaccard.verified(near, texts)
    assert links.count() <= 30 * 5000  # a tree for each cell of blocks
    left = jaccard.unsettled(met, components(links), near)
    assert jaccard.candidates(left).count() <= 10 * 5000


def cut_by_hand(rows, length, words):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for (i, text), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        inside = np.r_[False, np.cumsum(gone)[: len(b)] > 0, False]
        keep = np.ones(len(b), bool)
        for a, z in zip(np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:]), strict=True):
            whole = [(s, e) for s, e in word_places(b) if a <= s and e <= z]
            if len(whole) >= words:
                keep[a:z] = False
        out.append((i, None if text is None else bytes(np.frombuffer(b, np.uint8)[keep]).decode(errors="ignore")))
    return Counter(out)


def word_places(b):
    places, start = [], None
    for k, byte in enumerate(b + b" "):
        if byte in b" \t\n\v\f\r":
            if start is not None:
                places.append((start, k))
            start = None
        elif start is None:
            start = k
    return places


@pytest.mark.parametrize("segment", [1 << 19, 1_500])
def test_passages_of_51_words_go_and_shorter_ones_stay(table, monkeypatch, segment):
    monkeypatch.setattr(suffix, "SEGMENT", segment)
    rng = random.Random(23)
    long, short, edge = words_of(rng, 51), words_of(rng, 50), words_of(rng, 60)
    around = lambda p: " ".join([*words_of(rng, 30), *p, *words_of(rng, 30)])
    rows = [(i, around(p)) for i, p in enumerate([long, long, short, short, edge, edge, edge, words_of(rng, 80)])]
    rows += [(20, None), (21, ""), (22, " ".join(edge)), (22, " ".join(edge)), (23, "é" * 300), (24, "-" + "é" * 300), (25, around(words_of(rng, 900) + long))]
    got = Counter((r.doc_id, r.text) for r in suffix.without_repeats(table(rows)).collect())
    assert got == cut_by_hand(rows, suffix.PASSAGE_LENGTH, suffix.PASSAGE_WORDS)
    kept = dict(got)
    assert all(" ".join(long) not in (t or "") for _, t in kept) and sum(" ".join(short) in (t or "") for _, t in kept) == 2
    assert suffix.without_repeats(table(rows)).columns == table(rows).columns


def test_very_long_texts_keep_their_cuts_across_segments(table):
    rng = random.Random(24)
    body = " ".join(words_of(rng, 120_000))
    at = suffix.SEGMENT - 700  # a passage across the first cut
    rows = [(1, body), (2, "start " + body[at : at + 1400] + " end")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.digest(table(rows)).collect()}
    assert got == {1: (len(body), 1400, 1), 2: (1410, 1400, 1)}


def test_unwanted_texts_are_not_shuffled(spark):
    keyed = spark.range(20_000).select(F.xxhash64("id").alias("key_a"), F.xxhash64("id", F.lit(1)).alias("key_b"), F.col("id").alias("table"))
    wanted = keyed.where("table % 100 = 0").select("key_a", "key_b")
    left = {r.table for r in jaccard.likely(keyed, wanted).collect()}
    assert left >= set(range(0, 20_000, 100)) and len(left) < 400
    assert {r.table for r in jaccard.likely(keyed, wanted, how="left_anti").collect()} == set(range(20_000)) - left
    assert jaccard.likely(keyed, wanted.limit(0)).count() == 0


def test_tables_of_finished_steps_are_dropped(spark):
    tables = lambda: {f.parent for f in Path(shared_folder(spark)).glob("*/_SUCCESS")}
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: 60 - i % 7], f"x{i}"])) for i in range(40)] + [(3, None), (None, "alone"), (50, "alone"), (50, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    there = tables()
    kept = jaccard.first_of_each(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "3", "50"]
    assert len(tables() - there) <= 5  # measured rows, links and their components, labels, doubtful keys


def test_a_written_table_leaves_no_shuffle_files(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    there = files()
    table = cut_lineage(spark.range(5_000).groupBy((F.col("id") % 50).alias("k")).count())
    assert not files() - there
    assert table.count() == 50
    assert spark.conf.get(CLEANUP) == "false"
    discard(table)
    assert not Path(table.lineage_path).exists()
