"""Binary files of token ids in directly addressable codes.

An id is cut into chunks of ``CHUNK`` bits, lowest first. Level 0 holds the first chunk of every id,
level 1 the second chunk of the ids that have one, and so on. A bitmap per level says which ids go
on, and a directory of ranks says how many did before each block of bits, so that an id's place in
the next level follows from two look-ups: any id is read without decoding its neighbours.

A file, little-endian throughout::

    MAGIC
    segments of up to SEGMENT ids; in each, level by level:
        chunks (a byte each), bitmap (64-bit words), ranks (32 bits before each block of 512 bits)
    documents: ids (64 bits), whether they are null (a byte each), starts (64 bits, one more)
    table of segments: ids, offset, ids at each level
    offset of the documents, number of documents, offset of the table, number of segments, MAGIC

Files are written by the tasks of one job under names of their own; what a failed or repeated
attempt leaves is never listed, so only whole files are read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.functions.lineage import shared_folder
from callsheet.llm.bpe import byte_symbols

VOCABULARY = "word_bpe_49k.json"
#: Written behind each document's ids.
END = 2
MAGIC = b"DACIDS01"
CHUNK, LEVELS = 8, 4
BLOCK_WORDS = 8
SEGMENT = 1 << 20
TAIL = 4 * 8 + len(MAGIC)
#: Pieces of text whose ids a worker keeps, and how long they may be.
KEPT_PIECES, KEPT_LENGTH = 200_000, 64
#: A word of Latin letters, whose case and composition are plain, and punctuation behind it, which no
#: token shares with letters. Apostrophes are left out, as they may begin a word's ending.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)]*)")
#: Characters of a long text that are cut into pieces at a time.
STRETCH = 1 << 20
#: Documents that one reading task takes at most, and rows of its batches.
READ, ROWS = 1 << 16, 4096


# --- encoding ------------------------------------------------------------------------------------


class Kept(dict):
    """What ``work`` gives for a text, kept in two generations of at most ``KEPT_PIECES``."""

    def __init__(self, work: Callable[[str], bytes]):
        self.work = work
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.work(text)
        if len(text) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Pieces(Kept):
    """Ids of pieces between white space, as bytes, worked out by the library when first seen.

    A plain word goes straight to the library's merges, other pieces through all of its steps. Words
    are kept in small letters as well, since most new pieces are a known word with another case or
    other marks behind it.
    """

    def __init__(self, name: str):
        super().__init__(self.piece)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = self.library.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.words = Kept(self.word)

    def word(self, symbols: str) -> bytes:
        """Ids of a plain word in small letters."""
        if not symbols.isascii():
            symbols = symbols.encode().decode("latin-1").translate(self.symbols)
        return array("I", [token.id for token in self.merges.tokenize(symbols)]).tobytes()

    def piece(self, piece: str) -> bytes:
        plain = PLAIN.fullmatch(piece)
        if not plain:
            return array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()
        letters, marks = plain.groups()
        ids = self.words[letters.lower()]
        return ids + self[marks] if marks else ids


@lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(name)


def stretches(text: str) -> Iterator[str]:
    """The text in stretches of about ``STRETCH`` characters that end at a space."""
    at = 0
    while len(text) - at > STRETCH:
        end = text.find(" ", at + STRETCH)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def encode(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Token ids of a whole text, as the library gives them.

    The vocabulary drops white space and no token reaches across it, so texts are encoded piece by
    piece; white space other than blanks, tabs and line ends stays inside the pieces.
    """
    known = pieces(vocabulary)
    out = [b"".join(map(known.__getitem__, part.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for part in stretches(text)]
    return np.frombuffer(out[0] if len(out) == 1 else b"".join(out), np.uint32)


# --- the code ------------------------------------------------------------------------------------


def _words(n: int) -> int:
    return -(-n // 64)


def _blocks(n: int) -> int:
    return -(-_words(n) // BLOCK_WORDS) + 1


def level_bytes(n: int) -> int:
    """Bytes that a level of ``n`` chunks takes."""
    return n + 8 * _words(n) + 4 * _blocks(n)


def packed(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """A segment's levels one behind the other, and the number of chunks at each."""
    parts: list[bytes] = []
    counts: list[int] = []
    rest = ids.astype(np.uint32)
    while len(rest):
        chunks = (rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8)
        rest = rest >> np.uint32(CHUNK)
        more = rest > 0
        bits = np.zeros(64 * BLOCK_WORDS * (_blocks(len(more)) - 1), bool)
        bits[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64 * BLOCK_WORDS).sum(axis=1))]).astype("<u4")
        parts += [chunks.tobytes(), np.packbits(bits, bitorder="little")[: 8 * _words(len(more))].tobytes(), ranks.tobytes()]
        counts.append(len(more))
        rest = rest[more]
    return b"".join(parts), counts


Reader = Callable[[int, int], bytes]


def _rank(read: Reader, at: int, n: int, i: int) -> int:
    """Ids of a level at ``at`` that go on before its ``i``-th."""
    word, bitmap = i // 64, at + n
    block = word // BLOCK_WORDS
    before = int.from_bytes(read(bitmap + 8 * _words(n) + 4 * block, 4), "little")
    span = int.from_bytes(read(bitmap + 8 * block * BLOCK_WORDS, 8 * (min(word + 1, _words(n)) - block * BLOCK_WORDS)), "little")
    return before + (span & ((1 << (i - 64 * block * BLOCK_WORDS)) - 1)).bit_count()


def ids_between(read: Reader, counts: list[int], start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a segment. ``read(offset, n)`` gives bytes of the segment.

    Only the chunks, bits and ranks of these ids are read; those of neighbours are not decoded.
    """
    out = np.zeros(stop - start, np.uint32)
    where = np.arange(stop - start)
    at = 0
    for level, n in enumerate(counts):
        if start == stop:
            break
        chunks = np.frombuffer(read(at + start, stop - start), np.uint8)
        out[where] |= chunks.astype(np.uint32) << np.uint32(CHUNK * level)
        first = start // 8
        bits = np.unpackbits(np.frombuffer(read(at + n + first, -(-stop // 8) - first), np.uint8), bitorder="little")
        more = bits[start - 8 * first : stop - 8 * first].astype(bool)
        where = where[more]
        start = _rank(read, at, n, start) if len(where) else 0
        stop = start + len(where)
        at += level_bytes(n)
    return out


# --- files ---------------------------------------------------------------------------------------


class Part(NamedTuple):
    """A written file: its name, its place in the order, and what it holds."""

    name: str
    place: int
    documents: int
    tokens: int


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI or an absolute path."""
    return fs.FileSystem.from_uri(folder)


class Writer:
    """Writes one file; holds a segment's ids and sixteen bytes for each document."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.held: list[np.ndarray] = []
        self.waiting = self.tokens = 0
        self.segments: list[tuple[int, int, list[int]]] = []
        self.ids, self.nulls, self.starts = array("q"), bytearray(), array("q", [0])
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.tokens += len(ids)
        self.starts.append(self.tokens)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= SEGMENT:
            self.flush(SEGMENT)

    def flush(self, least: int) -> None:
        """Write whole segments while ``least`` ids wait; a rest stays."""
        every = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        at = 0
        while len(every) - at >= least and at < len(every):
            own = every[at : at + SEGMENT]
            data, counts = packed(own)
            self.segments.append((len(own), self.at, counts))
            self.put(data)
            at += len(own)
        self.held, self.waiting = [every[at:]], len(every) - at

    def close(self) -> None:
        self.flush(1)
        documents = self.at
        self.put(np.frombuffer(self.ids, np.int64).astype("<i8").tobytes() + bytes(self.nulls) + np.frombuffer(self.starts, np.int64).astype("<i8").tobytes())
        table = self.at
        rows = [[n, at, *counts, *[0] * (LEVELS - len(counts))] for n, at, counts in self.segments]
        self.put(np.array(rows, "<i8").tobytes())
        self.put(np.array([documents, len(self.nulls), table, len(rows)], "<i8").tobytes() + MAGIC)
        self.out.close()


class TokenFile:
    """Reads a written file: any id, any range of ids, any document."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(TAIL, size - TAIL)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"no whole file of token ids: {path}")
        documents, self.documents, table, segments = np.frombuffer(tail[: -len(MAGIC)], "<i8").tolist()
        own = np.frombuffer(self.file.read_at(8 * (2 + LEVELS) * segments, table), "<i8").reshape(segments, 2 + LEVELS)
        self.first = np.concatenate([[0], np.cumsum(own[:, 0])])
        self.offsets, self.counts = own[:, 1], own[:, 2:]
        self.places = (documents, documents + 8 * self.documents, documents + 9 * self.documents)
        self.cached: tuple[int, bytes] = (-1, b"")

    def __len__(self) -> int:
        return int(self.first[-1])

    def index(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, whether they are null, and starts (one more) of documents ``start`` to ``stop``."""
        n = stop - start
        ids, nulls, starts = self.places
        return (
            np.frombuffer(self.file.read_at(8 * n, ids + 8 * start), "<i8"),
            np.frombuffer(self.file.read_at(n, nulls + start), np.uint8).astype(bool),
            np.frombuffer(self.file.read_at(8 * (n + 1), starts + 8 * start), "<i8"),
        )

    def _direct(self, segment: int) -> Reader:
        base = int(self.offsets[segment])
        return lambda at, n: self.file.read_at(n, base + at)

    def _whole(self, segment: int) -> Reader:
        """Bytes from the segment as a whole, which is kept until another one is asked for."""
        if self.cached[0] != segment:
            size = sum(level_bytes(int(n)) for n in self.counts[segment])
            self.cached = (segment, self._direct(segment)(0, size))
        data = self.cached[1]
        return lambda at, n: data[at : at + n]

    def __getitem__(self, i: int) -> int:
        """One id, from a few bytes of each level."""
        return int(self.between(i, i + 1)[0])

    def between(self, start: int, stop: int, scan: bool = False) -> np.ndarray:
        """Ids ``start`` to ``stop``. ``scan`` reads the segments they are in as wholes."""
        out = []
        segment = int(np.searchsorted(self.first, start, side="right")) - 1
        while start < stop:
            first, end = int(self.first[segment]), min(stop, int(self.first[segment + 1]))
            read = self._whole(segment) if scan else self._direct(segment)
            out.append(ids_between(read, [int(n) for n in self.counts[segment] if n], start - first, end - first))
            start, segment = end, segment + 1
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)

    def sums(self, starts: np.ndarray) -> list[int]:
        """CRC-32 of the ids from each of ``starts`` to the next one, as little-endian 32-bit integers.

        Consecutive documents are read together while they have no more ids than a segment.
        """
        out, i, n = [], 0, len(starts) - 1
        while i < n:
            j = max(i + 1, min(n, int(np.searchsorted(starts, starts[i] + SEGMENT, side="right")) - 1))
            data = memoryview(self.between(int(starts[i]), int(starts[j]), scan=True).astype("<u4").tobytes())
            ends = (4 * (starts[i : j + 1] - starts[i])).tolist()
            out += [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            i = j
        return out


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int | None = END) -> list[Part]:
    """Encode all texts and write their ids below ``folder`` in ascending order of ``doc_id``.

    ``docs`` has ``doc_id`` (long) and ``text``. Returns the files in their order. Null ids come
    first, rows of one id in the order of a hash of their texts; null texts count as empty. Rows
    are dealt out by ranges of id and hash, so an id that many rows share is spread as well.
    """
    system, path = opened(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        place = TaskContext.get().partitionId()
        name = f"{place:06d}-{uuid.uuid4().hex}.dac"
        last = np.zeros(0, np.uint32) if end is None else np.array([end], np.uint32)
        writer = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer = writer or Writer(system.open_output_stream(f"{path}/{name}"))
                writer.add(doc_id, np.concatenate([encode(text.as_py() or "", vocabulary), last]))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, place, len(writer.nulls), writer.tokens)], ["name", "place", "documents", "tokens"])

    order = [F.asc_nulls_first("doc_id"), F.asc("text_hash")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = dealt.mapInArrow(run, "name string, place bigint, documents bigint, tokens bigint").collect()  # a row for each file
    return sorted((Part(*f) for f in files), key=lambda f: f.place)


def read(spark, folder: str, parts: Iterable[Part]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is taken of the ids as
    little-endian 32-bit integers.
    """
    rows, base = [], 0
    for part in parts:
        rows += [(part.name, base, at, min(at + READ, part.documents)) for at in range(0, part.documents, READ)]
        base += part.tokens
    shape = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for batch in batches:
            for work in batch.to_pylist():
                file = TokenFile(system, f"{path}/{work['name']}")
                for at in range(work["first"], work["stop"], ROWS):
                    ids, nulls, starts = file.index(at, min(at + ROWS, work["stop"]))
                    sums = file.sums(starts)
                    columns = [pa.array(ids, mask=nulls), pa.array(starts[:-1] + work["base"]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    work = spark.createDataFrame(rows, "name string, base bigint, first bigint, stop bigint")
    return work.repartition(max(1, len(rows))).mapInArrow(run, shape)


def stored(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write all documents' ids to files in the shared folder and return what the files say.

    One row per input row, repeated rows included. Null and empty texts have the end id alone. An
    empty table gives no files and an empty table. Null ids come first. Long texts are encoded in
    stretches and span segments. Other columns are not read.
    """
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    return read(docs.sparkSession, folder, write(docs.select("doc_id", "text"), folder, vocabulary))
