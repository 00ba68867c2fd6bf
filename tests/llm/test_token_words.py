"""Words that the token files' encoder knows, and sums over documents read together."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from callsheet.llm import tokenfile


def test_a_word_is_merged_once_for_all_its_writings():
    known = tokenfile.Pieces(tokenfile.VOCABULARY)
    asked = []

    class Merges:
        def tokenize(self, symbols, real=known.merges):
            asked.append(symbols)
            return real.tokenize(symbols)

    known.merges = Merges()
    library = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    for piece in ["Quuxword", "quuxword", "quuxword,", "QUUXWORD!", "quuxword.", "Größe", "größe;"]:
        assert np.frombuffer(known[piece], np.uint32).tolist() == library.encode(piece, add_special_tokens=False).ids
    assert asked.count("quuxword") == 1 and len(asked) == 2


def test_sums_of_documents_read_together(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 50)
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 50_000, n).astype(np.uint32) for n in [0, 3, 49, 1, 50, 51, 0, 700, 2, 0, 10, 48]]
    system, path = tokenfile.opened(str(tmp_path))
    writer = tokenfile.Writer(system.open_output_stream(f"{path}/x"))
    for i, ids in enumerate(documents):
        writer.add(i, ids)
    writer.close()
    file = tokenfile.TokenFile(system, f"{path}/x")
    reads = []
    between = file.between
    file.between = lambda *a, **k: reads.append(a) or between(*a, **k)
    _, _, starts = file.index(0, len(documents))
    assert file.sums(starts) == [zlib.crc32(ids.astype("<u4").tobytes()) for ids in documents]
    assert len(reads) < len(documents) and file.sums(starts[:1]) == []
    assert all(b - a <= 50 or (a, b) in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for a, b in reads)
