"""Token ids of whole texts by the tokenizers library, word by word.

A tokenizer of this kind merges within words only, so the ids of a text are those of its
words in order. Words repeat: the library's model sees a word once a worker, while it is kept.
Texts with special tokens or letters outside the Latin script go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache

from tokenizers import Tokenizer

from .bpe import SPACE, USUAL, Words, byte_letters, little

LATIN = [chr(i) for i in range(0x250)]
LETTER = "".join(c for c in LATIN if unicodedata.category(c)[0] == "L")
NUMBER = "".join(re.escape(c) for c in LATIN if unicodedata.category(c)[0] == "N")
#: Words kept in each of two generations: some 80 MB a worker. The model's own table makes others cheap.
KEPT = 150_000
#: The contractions that both tokenizers split off.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


class TextIds:
    """encode_bytes(text): its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.lower = self.library.normalizer is not None
        if self.lower:
            rule = f"{ENDINGS}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"
        else:
            rule = rf"{ENDINGS}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        self.split, self.unusual = re.compile(rule).findall, re.compile(f"[^{USUAL}]").search
        self.letters = byte_letters()
        self.spell = {b: self.letters[b] for b in range(128)}
        self.kept = Words(self.word, kept)

    def whole(self, text: str) -> bytes:
        return little(self.library.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """Ids of one word, which the model takes in the letters that stand for its bytes."""
        spelled = word.translate(self.spell) if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return little([t.id for t in self.library.model.tokenize(spelled)])

    def encode_bytes(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        plain = text.isascii()
        split = text if not self.lower else (text if plain else unicodedata.normalize("NFC", text)).lower()
        if not plain and (self.unusual(text) or self.unusual(split)):  # a letter may leave the usual ones in lower case
            return self.whole(text)
        return b"".join(map(self.kept.__getitem__, self.split(split)))


@cache
def text_ids(path: str, kept: int = KEPT) -> TextIds:
    """One a worker and file."""
    return TextIds(path, kept)
