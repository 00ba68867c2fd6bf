"""Prefix trie, token files and whitening against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from callsheet.llm import prefixtrie, tokenfile, whitening

TURNS = "conv_id long, turn long, role string, text string, depth long, node string"
VECTORS = "vec_id long, embedding array<float>, n long, whitened string"


def turn_order(row):
    """Null numbers first; turns of one number by digest, as the operator's docstring says."""
    _, turn, role, text = row
    return turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def trie_by_hand(rows):
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in below}
        leaves = sum(not any(len(m) == len(n) + 1 and m[:-1] == n for m in below) for n in below)
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(n) == len(node) + 1 for n in below), leaves,
            sum((len(members[n]) - 1) * words[n] for n in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(rng, n, turns, texts):
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, turns)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("splitter_turns", [1, 2, 64])
def test_trie_matches_brute_force(spark, monkeypatch, splitter_turns):
    monkeypatch.setattr(prefixtrie, "SPLITTER_TURNS", splitter_turns)
    monkeypatch.setattr(prefixtrie, "SHARD", 12)
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    rng = random.Random(splitter_turns)
    rows = conversations(rng, 150, 5, ["a b", "c", "", None, "  x\ty "])
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(4)]  # a hot conversation
    rows += [(300, 0, "u", "x"), (300, 0, "u", "x"), (300, None, "u", "late"), (301, 5, "b", "t"), (301, 5, "a", "t"), (None, 0, "u", "lost"), (321, 0, "r", "long " * 50_000)]
    rows += [(400, t, "u", "deep") for t in range(90)] + [(401, t, "u", "deep") for t in range(100)]
    table = spark.createDataFrame([(*r, -1, "n") for r in rows], TURNS).repartition(5)
    got = sorted((tuple(r) for r in prefixtrie.trie(table).collect()), key=str)
    assert got == trie_by_hand(rows)


def test_trie_of_nothing_and_of_one_turnless_conversation(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefixtrie.trie(empty).collect() == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "u", "dropped, as its group has no first conversation")]
    table = spark.createDataFrame([(*r, -1, "n") for r in rows], TURNS)
    assert [tuple(r) for r in prefixtrie.trie(table).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_token_codes_give_any_id(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 7_001)
    rng = np.random.default_rng(0)
    ids = (rng.integers(0, 2**32, 30_000, dtype=np.uint64) >> rng.integers(0, 32, 30_000, dtype=np.uint64)).astype(np.uint32)
    cuts = [0, *sorted(rng.integers(0, 30_000, 200).tolist()), 30_000]
    system, path = tokenfile.opened(str(tmp_path))
    writer = tokenfile.Writer(system.open_output_stream(f"{path}/x"))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        writer.add(None if i == 3 else i, ids[a:b])
    writer.close()
    file = tokenfile.TokenFile(system, f"{path}/x")
    assert len(file) == 30_000
    for i in [0, 29_999, 7_000, 7_001, *rng.integers(0, 30_000, 500).tolist()]:
        assert file[i] == ids[i]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        assert file.between(a, b).tolist() == file.between(a, b, scan=True).tolist() == ids[a:b].tolist()
    names, nulls, starts = file.index(0, 201)
    assert starts.tolist() == cuts and np.flatnonzero(nulls).tolist() == [3] and names[5] == 5
    (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-9])
    with pytest.raises(ValueError, match="no whole file"):
        tokenfile.TokenFile(system, f"{path}/y")


def test_pieces_encode_as_the_library(monkeypatch):
    monkeypatch.setattr(tokenfile, "STRETCH", 50)
    library = Library.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    rng = random.Random(2)
    alphabet = "aàÀbßÉé ,.;!?'\"-\n\t\r\x1c\x85 ́Σσςµª12٣Łĳİ日本語ﬁ<|>"
    texts = ["", "<|endoftext|>x <|startoftext|>", "don't 's 'Re it'S.", "é .́", "no).", "x " * 200]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(400)]
    for text in texts:
        assert tokenfile.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_hold_every_document(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "ça", "x1"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (400, None), (401, ""), (402, "word " * 300_000), (-5, "before all")]
    library = Library.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    docs = spark.createDataFrame([(i, t, -1, "s") for i, t in rows], "doc_id long, text string, n_tokens long, start string").repartition(6)
    got = [tuple(r) for r in tokenfile.stored(docs).collect()]
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    crc = {t: zlib.crc32(np.array(v, "<u4").tobytes()) for t, v in ids.items()}
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((i or 0, len(ids[t]), crc[t]) for i, t in rows)
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    order = [r[0] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert tokenfile.stored(docs.limit(0)).collect() == []


def test_a_failed_attempt_leaves_no_document(spark):
    """Files of other attempts in the folder are not listed, so they are not read."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    folder = tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir"))
    first = tokenfile.write(docs, folder)
    second = tokenfile.write(docs, folder)
    assert {p.name for p in first}.isdisjoint(p.name for p in second)
    assert tokenfile.read(spark, folder, second).count() == 20


def whitening_by_hand(vectors, k=4):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(fit.shape[1], -1))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ basis / np.sqrt(values), values / np.trace(np.cov(fit.T.astype(float), bias=True).reshape(fit.shape[1], -1))


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(400, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32).tolist()
    rows = list(enumerate(good)) + [(1000 + i, good[0]) for i in range(150)] + [(0, good[1]), (None, good[2])]
    bad = [(2000, None), (2001, [None, *good[0][1:]]), (2002, [float("nan"), *good[0][1:]]), (2003, [float("-inf"), *good[0][1:]])]
    table = spark.createDataFrame([(i, v, -1, "w") for i, v in rows + bad], VECTORS).repartition(4)
    got = whitening.whiten(table).collect()
    n, deviation, white, explained = whitening_by_hand([v for _, v in rows])
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    sign = {}
    want = {i: (deviation[j], white[j]) for j, (i, _) in enumerate(rows) if i not in (0, None)}
    for r in got:
        if r.vec_id in want:
            d, w = want[r.vec_id]
            assert r.deviation == d
            s = sign.setdefault(r.component, 1 if r.whitened * w[r.component - 1] > 0 else -1)
            assert abs(r.whitened * s - w[r.component - 1]) < 1e-9
            assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_few_equal_or_short_vectors(spark):
    make = lambda vs: spark.createDataFrame([(i, v, -1, "w") for i, v in enumerate(vs)], VECTORS)
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([[], []])).collect() == []
    assert whitening.whiten(make([[1.0, 2.0]] * 5)).collect() == []
    line = whitening.whiten(make([[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])).collect()
    assert sorted((r.vec_id, r.component) for r in line) == [(0, 1), (1, 1), (2, 1)]
    short = whitening.whiten(make([[1.0], [1.0, 3.0], [4.0, 1.0]])).collect()
    assert sorted({(r.vec_id, r.deviation) for r in short}) == sorted((i, int(d)) for i, d in enumerate(whitening_by_hand([[1, 0], [1, 3], [4, 1]], 2)[1]))
    with pytest.raises(Exception, match="too large to quantise"):
        whitening.whiten(make([[1e30], [1.0]])).collect()


def test_solver_on_hard_matrices():
    rng = np.random.default_rng(6)
    rotation = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    graded = np.diag(10.0 ** -np.arange(8))
    cases = [rng.normal(size=(60, 24)), rng.normal(size=(5, 9)), np.vstack([np.eye(6), -np.eye(6)]), np.vstack([rotation, -rotation]), np.vstack([graded, -graded]), np.outer(rng.normal(size=9), np.ones(4))]
    for x in cases:
        x = x - x.mean(axis=0)
        r = np.linalg.qr(x, mode="r")
        r = np.vstack([r, np.zeros((x.shape[1] - len(r), x.shape[1]))])
        values, basis, trace = whitening.solved(r, len(x), x.shape[1])
        every = np.linalg.svd(x, compute_uv=False) ** 2 / len(x)
        assert np.allclose(values, every[: len(values)], rtol=1e-10, atol=0) and (every[len(values) :] < 1e-20 * every[0]).all()
        assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-10
        white = x @ basis / np.sqrt(values)
        assert np.abs(white.T @ white / len(x) - np.eye(len(values))).max() < 1e-9 and abs(trace / every.sum() - 1) < 1e-12


def test_deviations_stay_exact_beyond_longs():
    x = np.array([[2**52, -(2**52)], [1, 0]])
    assert whitening.deviations(x, 2**20, [5, 7]).tolist() == [[2**72 - 5, -(2**72) - 7], [2**20 - 5, -7]]
    with pytest.raises(OverflowError):
        whitening.squares(whitening.deviations(x, 2**20, [5, 7]))
