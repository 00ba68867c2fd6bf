"""Each operator against a brute-force version, and on nulls, empty tables, ties and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from callsheet.llm import bpe, decontam, jaccard, langid, quality, suffix, tokencount, topk, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long"


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names clash with operators' results."""

    def make(rows, partitions=3):
        return spark.createDataFrame([(i, t, None, None, None, -1.0, -1) for i, t in rows], DOCS).repartition(partitions)

    return make


def prose(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n))


def odd_texts():
    rng = random.Random(4)
    base = prose(rng, 300)
    return [(0, base), (1, base), (1, base), (2, base + " end"), (3, None), (4, ""), (5, " \n"), (6, "one"), (None, base), (None, None), (7, "é" * 500), (8, "x" * 70_000), (9, prose(rng, 20_000))]


def test_top_k_matches_all_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (None, [1.0] * 6), (305, [1.0, 2.0])]
    rows += [(400 + i, rows[0][1]) for i in range(15)] + [(0, rows[0][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in topk.search(table, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    known = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all()}
    for q in [i for i in known if i % 100 == 0]:
        ranked = sorted(((-int(known[q] @ v), i) for i, v in known.items() if i != q))[:10]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(ranked, 1)]
    assert topk.search(table.limit(0), F.lit(True)).count() == 0


def test_token_counts_answer_every_limit(docs):
    encode = tokencount.encoding(tokencount.VOCABULARY).encode_ordinary
    lengths = [len(encode(t or "")) for _, t in odd_texts()]
    found = tokencount.count(docs(odd_texts()))
    for r in found.collect():
        limit = r.context_limit
        assert (r.n_docs, r.docs_fitting) == (lengths.count(limit), sum(n <= limit for n in lengths))
        assert (r.tokens_kept, r.tokens_total) == (sum(min(n, limit) for n in lengths), sum(lengths))
    asked = {r.context_limit: (r.docs_fitting, r.tokens_kept) for r in tokencount.answer(found, [0, 5, 10**7]).collect()}
    assert asked == {n: (sum(x <= n for x in lengths), sum(min(x, n) for x in lengths)) for n in (0, 5, 10**7)}
    assert tokencount.count(docs(odd_texts()).limit(0)).count() == 0


def test_tokens_equal_the_librarys(docs):
    library = Library.from_file(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(2)
    texts = ["I'LL go <|endoftext|>ΣΑΣ İx\x85y\xa0½ 한국어 🙂", "aaaaaaaaaaaaaaa!!!!!!!!!!!", "a</w>b", "ᲉꟜ", "éÉ"]
    texts += [prose(rng, 50, "abcdetinosr'é1-") for _ in range(40)]
    rows = odd_texts() + [(100 + i, t) for i, t in enumerate(texts)]
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))))
    got = [tuple(r) for r in bpe.digest(bpe.tokenized(docs(rows))).collect()]
    assert Counter(got) == Counter(want)


def passages_removed(rows):
    data = {k: (t or "").encode() for k, (_, t) in enumerate(rows)}
    seen = Counter(b[p : p + 400] for b in data.values() for p in range(len(b) - 399))
    out = []
    for k, b in data.items():
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p] += 1
                gone[p + 400] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((rows[k][0], len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("together", [1_000, 3])
def test_repeated_passages_match_brute_force(docs, monkeypatch, together):
    monkeypatch.setattr(suffix, "TOGETHER", together)
    rng = random.Random(9)
    passage = prose(rng, 130)
    rows = [r for r in odd_texts() if r[0] not in (8, 9)] + [(50 + i, prose(rng, 40) + passage + prose(rng, 40)) for i in range(12)]
    rows += [(80, "ab" * 500), (81, passage[:399]), (82, passage[5:405]), (83, "z" * 1300)]
    assert Counter(tuple(r) for r in suffix.digest(docs(rows)).collect()) == Counter(passages_removed(rows))
    assert suffix.digest(docs(rows).limit(0)).count() == 0


def linked_components(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and 100 * len(x & y) >= 80 * len(x | y):
                    root[b] = root[a] = min(root[a], root[b])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return [(i, len(sets[k]), least.get(root[k])) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("limits", [(256, 1024), (2, 4)])
def test_jaccard_components_match_brute_force(docs, monkeypatch, limits):
    monkeypatch.setattr(jaccard, "PAIRED", limits[0])
    monkeypatch.setattr(jaccard, "BLOCK", limits[1])
    rng = random.Random(3)
    rows = [r for r in odd_texts() if r[0] != 9]
    for family in range(4):
        base = prose(rng, 60).split(" ")
        for k in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            rows.append((100 + 20 * family + k, " ".join(words).upper() if k % 2 else "\t".join(words)))
    got = Counter(tuple(r) for r in jaccard.score(docs(rows)).collect())
    assert got == Counter(linked_components(rows))
    kept = jaccard.first_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    groups = {c for _, n, c in linked_components(rows) if n}
    assert sorted(r.doc_id for r in kept.collect() if r.text and r.text.strip()) == sorted(groups)


def test_components_of_null_or_shared_ids_keep_a_row_each(docs):
    rng = random.Random(12)
    a, b, c, x, y, z = (prose(rng, 60) for _ in range(6))
    rows = [(None, a), (None, a + " end"), (None, b), (None, b), (None, c), (5, x), (7, x + " end"), (5, y), (5, y), (6, z), (6, z + " end")]
    kept = [(r.doc_id, r.text) for r in jaccard.first_of_each(docs(rows)).collect()]
    families = [{(None, a), (None, a + " end")}, {(None, b)}, {(None, c)}, {(5, x)}, {(5, y)}, {(6, z), (6, z + " end")}]
    assert len(kept) == len(families)
    assert all(len(family & set(kept)) == 1 for family in families)


def sellers(pattern, text):
    row = list(range(1))
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_matches_sellers(spark, docs):
    rng = random.Random(6)
    items = [(k, prose(rng, 30)) for k in range(6)] + [(6, None), (7, ""), (None, "x y z"), (8, "one")]
    rows = odd_texts()[:10]
    for k in range(30):
        text = list(items[k % 6][1])
        for _ in range(k % 9):
            text[rng.randrange(len(text))] = rng.choice(["", "q", "zz"])
        rows.append((200 + k, prose(rng, 10) + " " + "".join(text).upper() + "\n " + prose(rng, 10)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontam.contamination(docs(rows), benchmark).collect()}
    want = set()
    for i, text in rows:
        for k, item in items:
            if k is not None and item and text:
                pattern = decontam.normalised(item)
                edits = sellers(pattern, decontam.normalised(text)) if len(text) < 5000 else 10**6
                if edits <= decontam.budget(len(pattern)):
                    want.add((i, k, edits))
    assert got == want and any(e for _, _, e in got)
    clean = decontam.without_contaminated(docs(rows), benchmark)
    assert clean.count() == len([1 for i, _ in rows if i not in {w[0] for w in want}])
    assert decontam.contamination(docs(rows), benchmark.limit(0)).count() == 0


def test_url_verdicts_follow_the_dates(spark):
    day = lambda d: F.to_date(F.lit(d))
    entries = spark.createDataFrame(
        [("spam", "b.com", "add", "2024-01-10"), ("spam", "b.com", "remove", "2024-02-01"), ("adult", "a.b.com/x/", "add", "2024-01-20"), ("spam", "c.org", "add", "2024-03-01"), ("spam", "c.org", "remove", "2024-03-01"), ("spam", None, "add", "2024-01-01")],
        "list string, key string, action string, dated string",
    ).withColumn("dated", F.to_date("dated"))
    rows = [(1, "HTTP://u@A.b.com:80/x/y?q", "2024-01-09"), (2, "http://a.b.com/x/y", "2024-01-25"), (3, "http://a.b.com/x/y", "2024-02-01"), (4, None, "2024-01-25"), (5, "no url", "2024-01-25"), (6, "https://c.org/", "2024-05-01"), (7, "http://b.com", None)]
    captures = spark.createDataFrame(rows, "capture_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched"))
    got = {r.capture_id: (r.blocked, r.lists, r.reason) for r in urlfilter.verdicts(captures, entries).collect()}
    assert got == {1: (False, "", ""), 2: (True, "adult,spam", "a.b.com/x/"), 3: (True, "adult", "a.b.com/x/"), **{k: (False, "", "") for k in (4, 5, 6, 7)}}
    assert urlfilter.verdicts(captures.where(day("2024-01-01") > "2025-01-01"), entries).count() == 0


def test_url_entries_in_other_spellings_match(spark):
    entries = spark.createDataFrame(
        [("spam", "Example.COM", "add", "2024-01-10"), ("spam", "example.com.", "remove", "2024-03-01"), ("adult", "A.Other.org./Sec/", "add", "2024-01-10"), ("ads", "dot.net..", "add", "2024-01-10")],
        "list string, key string, action string, dated string",
    ).withColumn("dated", F.to_date("dated"))
    rows = [(1, "http://www.example.com/", "2024-02-01"), (2, "http://www.example.com/", "2024-03-02"), (3, "http://a.other.ORG/Sec/x", "2024-02-01"), (4, "http://a.other.org/sec/x", "2024-02-01"), (5, "http://dot.net", "2024-02-01")]
    captures = spark.createDataFrame(rows, "capture_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched"))
    got = {r.capture_id: (r.lists, r.reason) for r in urlfilter.verdicts(captures, entries).collect()}
    assert got == {1: ("spam", "example.com"), 2: ("", ""), 3: ("adult", "a.other.org/Sec/"), 4: ("", ""), 5: ("ads", "dot.net")}


def test_passages_lie_whole_in_a_window_wherever_they_stand():
    size = toxicity.WINDOW // 2 + 1
    index, _ = toxicity.windows(np.array([0, 200]))
    assert all(any(set(range(at, at + size)) <= set(row) for row in index.tolist()) for at in range(200 - size + 1))


def test_toxicity_of_a_passage_holds_when_shifted():
    rng = random.Random(21)
    clean = prose(rng, 400).split(" ")
    bad = prose(rng, 16, "uvwxyz").split(" ")
    texts = [" ".join(rng.choices(clean, k=60)) for _ in range(60)]
    texts += [" ".join([*rng.choices(clean, k=20), *bad, *rng.choices(clean, k=20)]) for _ in range(60)]
    model = toxicity.fit(texts, np.arange(120) >= 60)
    around = rng.choices(clean, k=160)
    scores = toxicity.scores_of(model, toxicity.pa.array([" ".join(around[:at] + bad + around[at:]) for at in range(100)]))
    assert scores.min() > 0.5 and scores.max() - scores.min() < 0.1


def test_toxicity_sample_counts_usable_documents(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 3)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 4)
    rows = [(i, f"text {i}") for i in range(40)] + [(i, "x" * (toxicity.SAMPLE_BYTES + 1)) for i in range(40, 200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    got = Counter(r.toxic for r in toxicity.sample(docs(rows).select("doc_id", "text"), labels).collect())
    assert got == {True: 3, False: 4}


def test_scores_learn_and_survive_odd_rows(spark, docs):
    rng = random.Random(8)
    good = [(i, prose(rng, 60).capitalize() + ".") for i in range(1000, 1150)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for i in range(1150, 1300)]
    labels = spark.createDataFrame([(i, int(i < 1150), int(i >= 1150)) for i in range(1000, 1300)] + [(None, 1, 1), (1000, 1, 0), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = odd_texts() + good + [(i, t + " scumbag") for i, t in bad]
    for module, label in ((quality, lambda i: i < 1150), (toxicity, lambda i: i >= 1150)):
        got = module.score(docs(rows), labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
        assert np.mean([r.predicted == label(r.doc_id) for r in held]) > 0.95
        assert module.score(docs(rows).limit(0), labels).count() == 0
        assert {r.score for r in module.score(docs(rows[:3]), labels.limit(0)).collect()} <= {0.0, 0.5, 0.0 + 0.5}


def test_network_gradients():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, toxicity.WINDOW, toxicity.INPUTS)).astype(np.float32)
    x[:, :, -1] = 1
    x[0, 20:] = 0
    net = {k: w.astype(np.float64) for k, w in toxicity.new_net().items()}
    z, kept = toxicity.forward(net, x.astype(np.float64), keep=True)
    slopes = toxicity.backward(net, kept, np.ones(3))
    for name, w in net.items():
        place = tuple(rng.integers(0, s) for s in w.shape)
        moved = {k: v.copy() for k, v in net.items()}
        moved[name][place] += 1e-3
        rise = (toxicity.forward(moved, x.astype(np.float64))[0] - z).sum() / 1e-3
        assert abs(rise - slopes[name][place]) < 2e-2 * max(1, abs(rise))


def test_language_codes(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40, "abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "vv") for i in range(200)]
    rows += [(500, None, "aa"), (501, "12 !?", "aa"), (None, "abc", None), (502, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (500, 501, 502)} == {"und"}
    truth = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 200)
    assert {r.lang_pred for r in langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(table.limit(0)).count() == 0
    for n in (2, 3, 6, 9):
        words = langid.codewords(n)
        assert len({tuple(w) for w in words}) == n and (np.abs(words) == 1).all()


def test_pipeline_runs_on_odd_documents(spark, docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    item = prose(rng, 30)
    rows = odd_texts() + [(60, prose(rng, 5) + " " + item + " " + prose(rng, 5)), (61, prose(rng, 80))]
    docs(rows).withColumn("lang", F.lit("aa")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [0, 6, 7, 8, 9, 61]
