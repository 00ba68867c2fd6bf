"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit vectors verify them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits allowed per character of an item.
ERROR_RATE = 0.05
#: Items are looked for in blocks of so many characters, so that what a task holds is bounded.
BLOCK_CHARS = 8_000_000

_SPACES = re.compile(r"\s+")


def normalised(text: str) -> str:
    """Lower case, with single spaces between words."""
    return _SPACES.sub(" ", text.lower()).strip()


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(rate * length)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` consecutive pieces; a match with so few edits leaves one of them whole."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def least_distance(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edits between the pattern and any part of ``text``, and where the first such part ends.

    Bit vectors hold the differences down a column; the pattern may start anywhere in the text.
    """
    last, whole = 1 << (length - 1), (1 << length) - 1
    up, down, score, best, place = whole, 0, length, length, 0
    for at, char in enumerate(text, 1):
        equal = masks.get(char, 0)
        cross = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        right = (down | ~(diagonal | up)) & whole
        left = up & diagonal
        if right & last:
            score += 1
        elif left & last:
            score -= 1
        right = right << 1 & whole
        left = left << 1 & whole
        up = (left | ~(cross | right)) & whole
        down = right & cross
        if score < best:
            best, place = score, at
    return best, place


class Items(NamedTuple):
    """Distinct normalised items of a block, with the ids that share each text."""

    texts: list[str]
    ids: list[list[int]]


class Matcher:
    """The pieces of a block's items in one search automaton."""

    def __init__(self, items: Items, rate: float):
        self.items = items
        self.errors = [budget(len(t), rate) for t in items.texts]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, text in enumerate(items.texts):
            for offset, piece in pieces(text, self.errors[k]):
                places.setdefault(piece, []).append((k, offset))
        self.search = ahocorasick.Automaton()
        for piece, found in places.items():
            self.search.add_word(piece, (len(piece), found))
        if places:
            self.search.make_automaton()
        self.masks = [{c: sum(1 << i for i, x in enumerate(t) if x == c) for c in set(t)} for t in items.texts]

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """``(item id, edits, end)`` of the best occurrence of each item that ``text`` holds."""
        text = normalised(text)
        if not self.items.texts or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, found) in self.search.iter(text):
            for k, offset in found:
                starts.setdefault(k, set()).add(end + 1 - size - offset)
        out = []
        for k, at in starts.items():
            length, errors = len(self.items.texts[k]), self.errors[k]
            best = (errors + 1, 0)
            begin = stop = -1
            for start in sorted(at):  # windows that overlap are read once
                low, high = max(0, start - errors), start + length + errors
                if begin >= 0 and low > stop:
                    best = min(best, self._verified(k, text, begin, stop))
                    begin = low
                begin, stop = (low if begin < 0 else begin), max(stop, high)
            best = min(best, self._verified(k, text, begin, stop))
            if best[0] <= errors:
                out += [(item, *best) for item in self.items.ids[k]]
        return sorted(out)

    def _verified(self, k: int, text: str, begin: int, stop: int) -> tuple[int, int]:
        exact = text.find(self.items.texts[k], begin, stop)
        if exact >= 0:
            return 0, exact + len(self.items.texts[k])
        edits, end = least_distance(self.masks[k], len(self.items.texts[k]), text[begin:stop])
        return edits, begin + end


_BUILT: dict[tuple, Matcher] = {}


def _matcher(key: tuple, items: Items, rate: float) -> Matcher:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(items, rate)
    return _BUILT[key]


def blocks(items: DataFrame, size: int = BLOCK_CHARS) -> Iterator[Items]:
    """Items in blocks of about ``size`` characters; the driver holds one block at a time."""
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text")
    known: dict[str, list[int]] = {}
    held = 0
    for row in rows.toLocalIterator():
        text = normalised(row["text"])
        if not text:
            continue
        if text not in known and known and held + len(text) > size:
            yield Items(list(known), list(known.values()))
            known, held = {}, 0
        held += 0 if text in known else len(text)
        ids = known.setdefault(text, [])
        if row["item_id"] not in ids:
            ids.append(row["item_id"])
    if known:
        yield Items(list(known), list(known.values()))


def matches_in(text: Column, items: Items, rate: float = ERROR_RATE) -> Column:
    """Matches of one block's items in each whole text."""
    key = (rate, hash(tuple(items.texts)), len(items.texts))

    @F.arrow_udf("array<struct<item_id: bigint, edits: int, end: bigint>>")
    def find(column: pa.Array) -> pa.Array:
        matcher = _matcher(key, items, rate)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("end", pa.int64())]))
        return pa.array([[dict(zip(("item_id", "edits", "end"), m, strict=True)) for m in matcher.find(t.as_py())] if t.is_valid else [] for t in column], kind)

    return find(text)


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Every pair of a document and a benchmark item it holds within the item's error budget.

    ``docs`` has ``doc_id, text``, ``benchmark`` has ``item_id, text``. Both are compared in lower
    case with single spaces. An item of n characters may differ by ``rate * n`` edits, rounded
    down, from some part of the document. Returns ``doc_id, item_id, edits, end_at`` with the
    fewest edits and, among those, the first end in the normalised text. Null and empty texts and
    items match nothing, nor do items of null id; rows repeated in ``docs`` give repeated pairs;
    items of the same text all match; an item id with several texts gives a pair for each text it
    holds. Without items, or for an empty table, the result is empty. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    out = None
    for items in blocks(benchmark):
        found = docs.select("doc_id", F.explode(matches_in(F.col("text"), items, rate)).alias("m"))
        pairs = found.select("doc_id", "m.item_id", "m.edits", F.col("m.end").alias("end_at"))
        out = pairs if out is None else out.unionAll(pairs)
    if out is None:
        return docs.where(F.lit(False)).select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).alias("edits"), F.lit(0).cast("bigint").alias("end_at"))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; all columns stay."""
    for items in blocks(benchmark):
        docs = docs.where(F.size(matches_in(F.col("text"), items, rate)) == 0)
    return docs
