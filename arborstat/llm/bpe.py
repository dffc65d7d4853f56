"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can end its encoding. An automaton over the
vocabulary lists the tokens that end at each position; a token is the prefix's last token
if it is reachable by merges and compatible with the last token of what stands before it.
Two tokens are compatible if no merge across their border fires while each of them is
being built. Following the stored tokens back from the word's end gives the exact ids.

Words repeat, so each worker keeps the ids of words seen, in a table of bounded size.

Defined results: null text is empty; empty text has no ids and decodes to an empty text;
strings of special tokens become their ids; rows are independent, so ties, repeated rows
and further columns change nothing; a word has no length limit.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import map_batches

#: Words kept with their ids in each of two generations, the longest of them in characters, and marks of
#: words seen once: some 140 MB a worker.
KEPT_WORDS, KEPT_LENGTH, MARKS = 250_000, 32, 1 << 21
#: Letters of the scripts that are split here once in lower case, and white space among them. Of texts with
#: others the library gives the words, since its tables are of another Unicode version than Python's;
#: the ids of words are found here in either case.
USUAL = r"\x00-\u024f\u2010-\u2027\u20ac"
SPACE = r"\t-\r \x85\xa0"
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


class Words(dict):
    """Word -> what `make` gives, of words that come a second time; two generations, so that common words survive a full table."""

    def __init__(self, make: Callable[[str], bytes], most: int = KEPT_WORDS):
        self.make, self.most, self.older, self.marks, self.marked = make, most, {}, bytearray(MARKS), 0

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self.make(word)
            place = hash(word) & (MARKS - 1)
            if not self.marks[place]:  # its first time, as for most words
                self.marks[place] = 1
                self.marked += 1
                if self.marked > MARKS // 2:
                    self.marks, self.marked = bytearray(MARKS), 0
                return out
        if len(word) <= KEPT_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


class PrefixBPE:
    """Encoder and decoder of a BPE vocabulary with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = np.empty(max([*vocab.values(), *self.special.values()]) + 1, dtype=object)
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        letters = byte_letters()
        # One private letter a unit: bytes within a word from 0x100, last bytes of a word from 0x200.
        self.inner, self.last = [chr(0x100 + b) for b in range(256)], [chr(0x200 + b) for b in range(256)]
        self.unit: dict[str, int] = {}
        for b, letter in enumerate(letters):
            for name, unit in ((letter, self.inner[b]), (letter + self.end, self.last[b])):
                if name in vocab:
                    self.unit[unit] = vocab[name]
        spelled = {i: u for u, i in self.unit.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair[left, right] = rank
            if whole not in spelled:
                spelled[whole] = spelled[left] + spelled[right]
                self.parts[whole], self.made_at[whole] = (left, right), rank
        self.length = {i: len(s) for i, s in spelled.items()}
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.matcher = ahocorasick.Automaton()
        reach: dict[int, bool] = dict.fromkeys(self.unit.values(), True)
        for i, (left, right) in self.parts.items():  # parts stand before what they make
            reach[i] = reach.get(left, False) and reach.get(right, False) and self.stable(left, right)
        for i, s in spelled.items():
            if reach[i]:
                self.matcher.add_word(s, i)
        self.matcher.make_automaton()
        self.kept, self.kept_spelled = Words(self.word_ids), Words(self.spelled_ids)
        self.byte_of = {letter: b for b, letter in enumerate(letters)}
        self.library = Tokenizer.from_file(path)
        specials = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.split_special = re.compile(f"({specials})") if specials else None
        marks = r"'s|'t|'re|'ve|'m|'ll|'d|"
        self.ascii_words = re.compile(marks + r"[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
        usual = [c for c in map(chr, range(0x250)) if c == c.lower()]  # what is judged is in lower case
        letter = "".join(c for c in usual if unicodedata.category(c)[0] == "L")
        number = "".join(c for c in usual if unicodedata.category(c)[0] == "N")
        self.words = re.compile(marks + f"[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+").findall
        self.unusual = re.compile(f"[^{USUAL}]").search

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank at which it goes into the next) from the border's unit up to `token`."""
        out = [(token, NEVER)]
        while token in self.parts:
            rank, token = self.made_at[token], self.parts[token][side]
            out.append((token, rank))
        return out[::-1]

    def stable(self, left: int, right: int) -> bool:
        """No merge across the border fires before both tokens are whole."""
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while i < len(a) - 1 or j < len(b) - 1:
            (x, x_at), (y, y_at) = a[i], b[j]
            rank = self.pair.get((x, y), NEVER)
            if rank < x_at and rank <= y_at:
                return False
            if x_at <= y_at:
                i += 1
            else:
                j += 1
        return True

    def fits(self, left: int, right: int) -> bool:
        """The two tokens stand side by side in the encoding of what they spell."""
        known = self.fits_memo.get((left, right))
        if known is None:
            if len(self.fits_memo) > 1_000_000:
                self.fits_memo.clear()
            known = self.fits_memo[left, right] = (left, right) not in self.pair and self.stable(left, right)
        return known

    def word_tokens(self, raw: bytes) -> list[int]:
        spelling = "".join([self.inner[b] for b in raw[:-1]]) + self.last[raw[-1]]
        ends: list[int] = [-1] * (len(spelling) + 1)
        length, fits, at, found = self.length, self.fits, -1, False
        for stop, token in self.matcher.iter(spelling):  # at each end the longest comes first
            if stop != at:
                at, found = stop, False
            if not found:
                before = stop + 1 - length[token]
                if before == 0 or (ends[before] >= 0 and fits(ends[before], token)):
                    ends[stop + 1], found = token, True
        out, i = [], len(spelling)
        while i:
            out.append(ends[i])
            i -= length[ends[i]]
        return out[::-1]

    def word_ids(self, word: str) -> bytes:
        return little(self.word_tokens(word.encode()))

    def spelled_ids(self, word: str) -> bytes:
        """Of a word in the letters that stand for bytes."""
        return little(self.word_tokens(bytes(map(self.byte_of.__getitem__, word))))

    def plain_bytes(self, text: str) -> bytes:
        if text.isascii():
            return b"".join(map(self.kept.__getitem__, self.ascii_words(text.lower())))
        lower = unicodedata.normalize("NFC", text).lower()
        if self.unusual(text) or self.unusual(lower):  # a letter may leave the usual ones in lower case
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return b"".join([self.kept_spelled[word] for word, _ in found])
        return b"".join(map(self.kept.__getitem__, self.words(lower)))

    def encode_bytes(self, text: str) -> bytes:
        """The ids of `text` as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not self.split_special.search(text):
            return self.plain_bytes(text)
        return b"".join(np.array([self.special[s]], "<u4").tobytes() if s in self.special else self.plain_bytes(s) for s in self.split_special.split(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary names in order, special ones too, with a space between."""
        return " ".join(self.names[ids].tolist())


@cache
def encoder(path: str) -> PrefixBPE:
    """One a worker and file."""
    return PrefixBPE(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; see the module for odd cases."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for text in batch.column(1).to_pylist():
                raw = bpe.encode_bytes(text or "")
                counts.append(len(raw) // 4)
                ids_hash.append(hashlib.sha256(raw).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(slim, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
