"""Byte-pair encoding with a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It starts with one state and a loop for every basic symbol. Each merge
``(u, v)`` in turn puts in a gadget: the state after ``u`` is split, so that arcs labelled ``u``
lead to a copy without the arc ``v``, and wherever ``u`` then ``v`` could be read, an arc for the
new token leads to where ``v`` led. What it accepts in the end is exactly the tokenizations that
byte-pair encoding makes. A state is kept as its origin and the one arc it lost, so that compiling
takes one step per merge; an arc is looked up along the origins and then stored in a table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

VOCABULARY = "word_bpe_49k.json"
NEVER = 1 << 40
SHIFT = 20
END = "\uffff"
CACHED_WORDS = 60_000
CACHED_LENGTH = 64
CACHED_ARCS = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Automaton:
    """States are numbered by the token just read; ``origin[t]`` is the state its copy came from.

    A word is read with ``END`` behind it, which belongs to the tokens that end words.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], ending: str):
        size = max(vocabulary.values()) + 1
        self.labels = [""] * size
        for label, token in vocabulary.items():
            self.labels[token] = label
        self.left = [-1] * size
        self.origin = [-1] * size
        self.made = [-1] * size
        self.lost: dict[int, int] = {}
        for rank, (first, second) in enumerate(merges):
            self.gadget(vocabulary[first], vocabulary[second], vocabulary[first + second], rank)
        tokens = {
            label[: -len(ending)] + END if label.endswith(ending) and len(label) > len(ending) else label: token
            for label, token in vocabulary.items()
        }
        self.longest = max(map(len, tokens), default=0)
        self.length, self.shorter = array("i", [0] * size), array("i", [-1] * size)
        self.inner: dict[str, int] = {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for label, token in tokens.items():
            self.trie.add_word(label, token)
            self.length[token] = len(label)
            self.beginnings(label, tokens)
        self.arcs: dict[int, bool] = {}

    def beginnings(self, label: str, tokens: dict[str, int]) -> None:
        """Note the longest token that begins each beginning of ``label``, and the next shorter one."""
        longest = -1
        for stop in range(1, len(label) + 1):
            token = tokens.get(label[:stop], -1)
            if token >= 0:
                self.shorter[token], longest = longest, token
            self.inner[label[:stop]] = longest

    def gadget(self, first: int, second: int, merged: int, rank: int) -> None:
        """Split the state after ``first``; the merged token leads where ``second`` leads by now."""
        self.lost[first << SHIFT | second] = rank
        self.left[merged], self.origin[merged], self.made[merged] = first, second, rank

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` can be read after ``state``.

        An arc for a merged token was added where its left part had an arc at that time, so the
        left parts are followed down to a basic symbol. By the end of each of those gadgets the state
        must not have lost the arc, be it itself or the state it was copied from until then.
        """
        lost, made, origin, until = self.lost.get, self.made, self.origin, NEVER
        while token >= 0:
            now, limit = state, until
            while now >= 0:
                if lost(now << SHIFT | token, NEVER) < limit:
                    return False
                if 0 <= made[now] < limit:
                    limit = made[now]
                now = origin[now]
            until = made[token] + 1
            token = self.left[token]
        return True

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word of byte symbols, reading left to right, longest arcs first.

        Every beginning of a word has one accepted reading, so each place has one state at most and
        a place from which the end was not reached need not be entered again.
        """
        word += END
        end, at, out, dead = len(word), 0, [], set()
        inner, longest, beginning = self.inner, self.longest, self.trie.longest_prefix
        arcs, length, shorter = self.arcs, self.length, self.shorter
        while at < end:
            rest = word[at : at + longest]
            token = inner.get(rest[: beginning(rest)], -1)
            while True:
                if token < 0:  # back to the place before, and on with its next shorter arc
                    dead.add(at)
                    token = out.pop()
                    at -= length[token]
                elif at + length[token] not in dead:
                    if not out:
                        break
                    key = out[-1] << SHIFT | token
                    known = arcs.get(key)
                    if known is None:
                        known = arcs[key] = self.has_arc(out[-1], token)
                    if known:
                        break
                token = shorter[token]
            out.append(token)
            at += length[token]
        if len(self.arcs) > CACHED_ARCS:
            self.arcs.clear()
        return out


def char_class(chars: list[str]) -> str:
    """A character class of single characters, as ranges."""
    codes = sorted(map(ord, chars))
    starts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if c + 1 != after]
    return "[" + "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in zip(starts, ends, strict=True)) + "]"


def recent_letters() -> list[str]:
    """Letters and numbers of ``regex``'s Unicode version that Python's own version lacks."""
    known = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return [c for c in regex.findall(r"[\p{L}\p{N}]", known) if unicodedata.category(c) == "Cn"]


def word_pattern(pattern: str, recent: list[str], library: Library) -> regex.Pattern:
    """The vocabulary's word pattern, with letters and numbers as of its library's Unicode version."""
    shown = byte_symbols()
    joined = library.pre_tokenizer.pre_tokenize_str(" ".join(f"a{c}a" for c in recent))
    whole = {piece for piece, _ in joined}
    later = [c for c in recent if "a" + "".join(shown[b] for b in c.encode()) + "a" not in whole]
    if not later:
        return regex.compile(pattern)
    new = char_class(later)
    for given, meant in (
        (r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{new}]"),
        (r"[\p{L}]", rf"[\p{{L}}--{new}]"),
        (r"[\p{N}]", rf"[\p{{N}}--{new}]"),
    ):
        pattern = pattern.replace(given, meant)
    return regex.compile("(?V1)" + pattern)


LATIN = 0x250


def in_latin_1(text: str) -> bool:
    """Whether all characters lie below 0x100, told without looking at them one by one."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def latin_pattern(pattern: str) -> re.Pattern:
    """The word pattern with its classes written out, which is faster, for text below ``LATIN``."""
    found = {name: [chr(c) for c in range(LATIN) if regex.match(name, chr(c))] for name in (r"\p{L}", r"\p{N}", r"\s")}
    for name, chars in found.items():
        pattern = pattern.replace(name, char_class(chars)[1:-1])
    return re.compile(pattern)


class Tokenizer:
    """A vocabulary file's splitting rules around its automaton.

    ``kept`` holds the ids of recent words and ``older`` those of the words before them.
    """

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.labels = self.automaton.labels + [""] * (max([0, *self.special.values()]) + 1 - len(self.automaton.labels))
        for content, token in self.special.items():
            self.labels[token] = content
        self.latin_words = latin_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.beyond_latin = re.compile(f"[^\\x00-\\u{LATIN - 1:04x}]")
        self.parts = regex.compile("(" + "|".join(regex.escape(c) for c in self.special) + ")")
        recent = recent_letters()
        library = Library.from_file(public_tokenizers.path(name))
        self.normalizer = library.normalizer  # the rest of the library's memory is freed
        self.recent = regex.compile(char_class(recent)) if recent else regex.compile("(?!)")
        self.words = word_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], recent, library)
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalised(self, text: str) -> str:
        """Composed and lower-cased character by character; white space only separates words."""
        if in_latin_1(text):  # composed as it is, and without any recent letter
            return text.lower()
        if self.recent.search(text):  # characters whose case Python does not know yet
            return self.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encoded_word(self, word: str) -> bytes:
        ids = self.kept.get(word) or self.older.get(word)
        if ids is None:
            plain = word.isascii() and word.isprintable()  # such bytes stand for themselves
            symbols = word if plain else word.encode("utf-8").decode("latin-1").translate(self.symbols)
            ids = array("i", self.automaton.encode(symbols)).tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self.kept) >= CACHED_WORDS:
                self.kept, self.older = {}, self.kept
            self.kept[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        kept = self.kept.get
        pieces = self.parts.split(text) if "<|" in text else [text]
        for piece in pieces:
            token = self.special.get(piece)
            if token is not None:
                out.append(np.int32(token).tobytes())
                continue
            piece = self.normalised(piece)
            latin = in_latin_1(piece) or not self.beyond_latin.search(piece)
            words = self.latin_words if latin else self.words
            out += [kept(word) or self.encoded_word(word) for word in words.findall(piece)]
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(name: str) -> Tokenizer:
    """Compiled once per worker."""
    return Tokenizer(name)


def encoded(column: pa.Array, tokens: Tokenizer) -> pa.Array:
    rows = [tokens.encode(t.as_py()) if t.is_valid else np.zeros(0, np.int32) for t in column]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(rows) if rows else np.zeros(0, np.int32))


def decoded(ids: pa.Array, tokens: Tokenizer) -> pa.Array:
    ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    return pa.array([tokens.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def encode(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Token ids of each whole text; null counts as empty."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        return encoded(column, tokenizer(vocabulary))

    return run(text)


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """Text of each list of ids: the labels of its arcs, joined as the vocabulary's library does."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return decoded(column, tokenizer(vocabulary))

    return run(ids)


def round_trip(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """``struct(ids, decoded)``: a text encoded, and its ids decoded, in one evaluation.

    ``decode(encode(text))`` beside ``encode(text)`` would encode twice, once for each column.
    """

    @F.arrow_udf("ids array<int>, decoded string")
    def run(column: pa.Array) -> pa.Array:
        tokens = tokenizer(vocabulary)
        ids = encoded(column, tokens)
        return pa.StructArray.from_arrays([ids, decoded(ids, tokens)], ["ids", "decoded"])

    return run(text)


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids, decoded`` of every whole text of ``docs`` (``doc_id``, ``text``).

    One row per input row, repeated rows included. Null and empty texts give no ids and an empty
    decoded text. Strings of special tokens in a text become those tokens. An empty table gives an
    empty table. Other columns are not read.
    """
    both = docs.select("doc_id", round_trip(F.col("text"), vocabulary).alias("both"))
    return both.select("doc_id", "both.ids", "both.decoded")


def digest(rows: DataFrame, *also: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``tokenized`` rows, and ``also``."""
    return rows.select(
        "doc_id",
        *also,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
