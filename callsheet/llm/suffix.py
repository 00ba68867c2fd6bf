"""Removal of repeated passages, found by building suffix order column by column.

Every position of a text is a suffix of which the first ``LENGTH`` bytes matter. The least hash of
a ``GRAM``-byte piece among those bytes, its anchor, is the same wherever the bytes recur, so
consecutive positions with one anchor travel as one string to the task that owns the anchor. Strings
are lined up at their anchors. The construction then goes from the last column to the first and
inserts one symbol of each string per round: a stable sort by the new symbol updates the suffix
order (the transform's mapping), and common prefixes grow by one over the least of the old ones in
between. The shuffled, sorted partitions are the sequential files: strings stream in by anchor and
only one batch of them is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.functions.lineage import cut_lineage, discard
from callsheet.llm.common import BASE, BASE_INVERSE, BYTE_VALUES, byte_views, mixed, powers, row_key, unused

LENGTH = 400
GRAM = 32
#: In texts, passages of so many whole words are cut where they recur, found by strings of so many
#: bytes: 51 words of prose have more (235 bytes at least in the given tables).
PASSAGE_WORDS, PASSAGE_LENGTH = 51, 200
#: Bytes taken at once; longer texts are cut with an overlap, each position stays in one piece.
SEGMENT = 1 << 19
#: Strings of one anchor up to this many are ordered together; more are cut into narrower pieces.
TOGETHER = 1_000
BATCH = 8_192


def anchored(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of positions with one anchor: start, number, anchor's offset, its hash, string's hash."""
    n, reach = len(data) - length + 1, length - GRAM + 1  # an anchor can have so many places
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    back = powers(BASE_INVERSE, len(data) + 1)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * back[: len(data) - GRAM + 1])
    least = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[reach - width : reach - width + n])
    place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    runs = np.diff(np.r_[starts, n])
    offset = place[starts] - starts
    ends = starts + runs + length - 1
    whole = mixed((sums[ends] - sums[starts]) * back[starts] + (runs * 1024 + offset).astype(np.uint64))
    return starts, runs, offset, grams[place[starts]], whole


def strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key_a, key_b, start, run, offset, anchor, whole`` of every text's runs of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key_a", "key_b", "start", "run", "offset", "anchor", "whole"]
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for texts in byte_views(batch.column(2)):
                parts, owner = [], []
                for i in range(len(texts)):
                    low, high = texts.bounds[i], texts.bounds[i + 1]
                    for at in range(low, high - length + 1, SEGMENT):
                        found = anchored(texts.data[at : min(at + SEGMENT + length - 1, high)], length)
                        parts.append((found[0] + at - low, *found[1:]))
                        owner.append(np.full(len(found[0]), texts.first + i))
                if parts:
                    rows = np.concatenate(owner)
                    start, runs, offset, anchor, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
                    columns = [keys[0][rows], keys[1][rows], start, runs.astype(np.int32), offset.astype(np.int32), anchor.view(np.int64), whole.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    shape = "key_a bigint, key_b bigint, start bigint, run int, offset int, anchor bigint, whole bigint"
    return docs.select("key_a", "key_b", "text").mapInArrow(run, shape)


def repeated_columns(rows: list[bytes], offsets: np.ndarray, runs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each string and position of its run, whether its ``length`` bytes occur in another one.

    The collection's suffix order and common prefixes after each inserted column decide: two
    strings share those bytes just if a neighbour in the order has a common prefix that long.
    """
    count, reach = len(rows), length - GRAM + 1
    lined = reach - 1  # column at which the anchors stand
    columns = lined + length
    grid = np.full((columns, count), 256, np.int16)
    for i, (row, offset) in enumerate(zip(rows, offsets, strict=True)):
        grid[lined - offset : lined - offset + len(row), i] = np.frombuffer(row, np.uint8)
    order = np.arange(count)
    common = np.zeros(count + 1, np.int32)  # with the string before; the last is a stop
    out = np.zeros((count, reach), bool)
    first, last = lined - offsets, lined - offsets + runs
    for column in range(columns - 1, -1, -1):
        symbols = grid[column][order]
        move = np.argsort(symbols, kind="stable")
        symbols = symbols[move]
        same = np.flatnonzero((symbols[1:] == symbols[:-1]) & (symbols[1:] < 256)) + 1
        fresh = np.zeros(count + 1, np.int32)
        if len(same):
            spans = np.empty(2 * len(same), np.int64)
            spans[0::2], spans[1::2] = move[same - 1] + 1, move[same] + 1
            fresh[same] = np.minimum.reduceat(common, spans)[0::2] + 1
        order, common = order[move], fresh
        if column <= lined:
            long = np.maximum(common[:-1], common[1:]) >= length
            own = order[long]
            own = own[(first[own] <= column) & (column < last[own])]
            out[own, column - first[own]] = True
    return out


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of the runs of true values in each row."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    return row, start, np.nonzero(step == -1)[1] - start


def ordered_together(contested: DataFrame, length: int = LENGTH) -> DataFrame:
    """``anchor, whole, at, n`` of repeated runs among strings ``anchor, whole, offset, run, bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def settle(table: pa.Table) -> pa.RecordBatch:
            offsets, runs = table.column("offset").to_numpy().astype(np.int64), table.column("run").to_numpy().astype(np.int64)
            row, at, n = _runs_of(repeated_columns(table.column("bytes").to_pylist(), offsets, runs, length))
            found = [table.column("anchor").to_numpy()[row], table.column("whole").to_numpy()[row], at.astype(np.int32), n.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["anchor", "whole", "at", "n"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows > BATCH:
                anchors = held.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchors, anchors[BATCH]))  # strings of an anchor stay together
                if not cut:
                    break
                yield settle(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield settle(held)

    rows = contested.select("anchor", "whole", "offset", "run", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "anchor bigint, whole bigint, at int, n int")


def narrowed(strings: DataFrame, width: int, length: int = LENGTH) -> DataFrame:
    """Strings cut into pieces of up to ``width`` positions, whose ``group`` is what they all cover.

    Positions at a distance of ``b * width`` up to the next multiple from the anchor all cover the
    same bytes around it. Only pieces that agree on those can share a position's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "whole", "at", "offset", "run", "group", "piece", "bytes"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for anchor, whole, offset, run, data in zip(*columns, strict=True):
                at = 0
                while at < run:
                    band = (offset - at) // width
                    n = min(run - at, offset - at - band * width + 1)
                    core = data[offset - band * width : offset - (band + 1) * width + 1 + length]
                    own = data[at : at + n + length - 1]
                    group = hashlib.blake2b(core, digest_size=16, key=b"%d %d %d" % (anchor, band, width)).digest()
                    piece = hashlib.blake2b(own, digest_size=16, key=b"%d" % (offset - at)).digest()
                    rows.append((anchor, whole, at, offset - at, n, group, piece, own))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    shape = "anchor bigint, whole bigint, at int, offset int, run int, group binary, piece binary, bytes binary"
    return strings.select("anchor", "whole", "offset", "run", "bytes").mapInArrow(run, shape)


def marked(strings: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = (32, 4, 1)) -> DataFrame:
    """``anchor, whole, at, n`` of repeated runs among strings ``anchor, whole, offset, run, bytes, strings``.

    Strings of an anchor of up to ``TOGETHER`` are ordered. Those of a larger one are cut into
    narrower pieces; equal pieces are counted, and the different ones of a group go the same way
    again. Pieces of one position are equal or have nothing in common, which ends it.
    """
    marks = ordered_together(strings.where(F.col("strings") <= TOGETHER), length)
    large = strings.where(F.col("strings") > TOGETHER)
    if not widths or large.isEmpty():
        return marks
    pieces = cut_lineage(narrowed(large, widths[0], length))
    kinds = pieces.groupBy("group", "piece").agg(F.count("*").alias("copies"), F.first("offset").alias("offset"), F.first("run").alias("run"), F.first("bytes").alias("bytes"))
    numbers = kinds.groupBy("group").agg(F.count("*").alias("strings")).where("strings > 1")
    open_pieces = cut_lineage(kinds.join(numbers, "group").select(
        F.xxhash64("group").alias("anchor"), F.xxhash64(F.lit("p"), "group", "piece").alias("whole"), "offset", "run", "bytes", "strings",
    ))
    inner = marked(open_pieces, length, widths[1:]).select(F.col("anchor").alias("g"), F.col("whole").alias("p"), F.col("at").alias("inner_at"), F.col("n").alias("inner_n"))
    named = pieces.select("anchor", "whole", "at", "run", "group", "piece", F.xxhash64("group").alias("g"), F.xxhash64(F.lit("p"), "group", "piece").alias("p"))
    copies = kinds.where("copies > 1").select("group", "piece")
    equal = named.join(copies, ["group", "piece"], "left_semi").select("anchor", "whole", "at", F.col("run").alias("n"))
    partly = named.join(inner, ["g", "p"]).select("anchor", "whole", (F.col("at") + F.col("inner_at")).alias("at"), F.col("inner_n").alias("n"))
    return marks.unionAll(equal).unionAll(partly)


def cut_out(docs: DataFrame, pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``anchor, whole, offset, run, strings, bytes`` of wanted strings, read from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "whole", "offset", "run", "strings", "bytes"]
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py().encode()
                wanted = batch.column(2)[i].as_py()
                cut = [data[w["start"] : w["start"] + w["run"] + length - 1] for w in wanted]
                columns = [pa.array([w[c] for w in wanted], kind) for c, kind in zip(names[:-1], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], names)

    listed = pieces.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("anchor", "whole", "start", "offset", "run", "strings")).alias("wanted"))
    rows = docs.join(listed, ["key_a", "key_b"]).select("doc_id", "text", "wanted")
    return rows.mapInArrow(run, "anchor bigint, whole bigint, offset int, run int, strings bigint, bytes binary")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key_a, key_b, marks``: positions ``start`` of ``run`` suffixes whose bytes recur.

    ``docs`` has ``doc_id, key_a, key_b, text``. Equal strings are counted and need no order; of
    an anchor's different strings, one occurrence each is read and ordered.
    """
    found = cut_lineage(strings(docs, length))
    place = F.struct("key_a", "key_b", "start", "offset", "run")
    kinds = found.groupBy("anchor", "whole").agg(F.count("*").alias("copies"), F.min(place).alias("first"))
    kinds = cut_lineage(kinds)
    contested = kinds.groupBy("anchor").agg(F.count("*").alias("strings")).where("strings > 1")
    wanted = kinds.join(contested, "anchor").select("anchor", "whole", "first.*", "strings")
    texts = cut_lineage(cut_out(docs, wanted, length))
    marks = marked(texts, length).groupBy("anchor", "whole").agg(F.collect_list(F.struct("at", "n")).alias("some"))
    several = kinds.where("copies > 1").select("anchor", "whole", F.lit(True).alias("all"))
    told = several.join(marks, ["anchor", "whole"], "full").select("anchor", "whole", F.coalesce("all", F.lit(False)).alias("all"), "some")
    whole = F.array(F.struct(F.col("start"), F.col("run").cast("bigint").alias("n")))
    some = F.transform("some", lambda m: F.struct((F.col("start") + m["at"]).alias("start"), m["n"].cast("bigint").alias("n")))
    joined = found.join(told, ["anchor", "whole"]).select("key_a", "key_b", F.when(F.col("all"), whole).otherwise(some).alias("m"))
    places = cut_lineage(joined.groupBy("key_a", "key_b").agg(F.flatten(F.collect_set("m")).alias("marks")))
    discard(found, kinds, texts)
    return places


def covered(marks: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start at the marks."""
    out: list[list[int]] = []
    for start, n in sorted((m["start"], m["n"]) for m in marks or []):
        stop = start + n + length - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def whole_words(data: bytes, start: int, stop: int) -> int:
    """Words that lie whole within ``data[start:stop]``."""
    own = data[start:stop].split()
    cut = bool(own) and start > 0 and not data[start - 1 : start].isspace() and not data[start : start + 1].isspace()
    ends = len(own) > cut and stop < len(data) and not data[stop : stop + 1].isspace() and not data[stop - 1 : stop].isspace()
    return len(own) - cut - ends


def removed(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """Each row's bytes without the repeated passages of ``length`` bytes and ``words`` words or more.

    ``docs`` has ``doc_id, text``. Returns ``doc_id, key_a, key_b, n_bytes, spans, kept``: ``spans``
    lists the removed ``[start, stop)`` and ``kept`` holds the bytes that remain.
    """
    keyed = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key_a", "key_b", "n_bytes", "spans", "kept"]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, marks in zip(batch.column(3), batch.column(4), strict=True):
                data = text.as_py().encode()
                gone = [(a, b) for a, b in covered(marks.as_py(), length) if not words or whole_words(data, a, b) >= words]
                edges = [0, *(x for span in gone for x in span), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "stop": b} for a, b in gone])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names)

    found = repeats(keyed, length)
    rows = keyed.join(found, ["key_a", "key_b"], "left").select("doc_id", "key_a", "key_b", "text", "marks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key_a bigint, key_b bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")


def digest(docs: DataFrame, *also: str) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of ``docs`` (``doc_id``, ``text``).

    One row per input row; a repeated row is a copy like any other, so that all of its bytes go if
    it has ``LENGTH`` or more. Null and empty texts have no bytes; texts shorter than ``LENGTH``
    keep all. ``also`` may name ``text``, what is left of it less characters that lost some of their
    bytes, and ``spans``. Matches are told by hashes of 64 bits within the strings of one 64-bit
    anchor and otherwise by their bytes. An empty table gives an empty table. Other columns are not
    read.
    """
    lengths = F.aggregate(F.transform("spans", lambda s: s["stop"] - s["start"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    more = {"text": left_text("kept").alias("text"), "spans": F.col("spans")}
    return removed(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", lengths.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *[more[c] for c in also]
    )


@F.arrow_udf(T.StringType())
def left_text(kept: pa.Array) -> pa.Array:
    """Text of bytes that may begin or end within a character."""
    return pa.array([k.as_py().decode("utf-8", errors="ignore") for k in kept], pa.string())


def without_repeats(docs: DataFrame, length: int = PASSAGE_LENGTH, words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all other columns and rows stay.

    A passage is a maximal run of bytes covered by strings of ``length`` bytes that start elsewhere
    too; it goes, in all of its copies, if ``words`` words or more lie whole within it. A character
    that lost a part of its bytes goes. Null texts stay null.
    """

    @F.arrow_udf("string")
    def cut(text: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for t, m in zip(text, marks, strict=True):
            found = covered(m.as_py(), length)
            data = t.as_py().encode() if found else b""
            gone = [(a, b) for a, b in found if whole_words(data, a, b) >= words]
            if not gone:
                out.append(t.as_py())
                continue
            edges = [0, *(x for span in gone for x in span), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
            out.append(kept.decode("utf-8", errors="ignore"))
        return pa.array(out, pa.string())

    a, b = row_key(F.col("doc_id"), F.col("text"))
    found = repeats(docs.select("doc_id", a, b, F.coalesce("text", F.lit("")).alias("text")), length)
    name_a, name_b, name_m = (unused(docs, n) for n in ("row_key_a", "row_key_b", "row_marks"))
    found = found.select(F.col("key_a").alias(name_a), F.col("key_b").alias(name_b), F.col("marks").alias(name_m))
    joined = docs.withColumn(name_a, a).withColumn(name_b, b).join(found, [name_a, name_b], "left")
    return joined.withColumn("text", cut("text", name_m)).select(*docs.columns)
