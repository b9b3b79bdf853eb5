"""Token ids of whole texts, word by word.

White space always ends a token of the given tokenizer, so a text's ids are its
words' ids one after another. Each worker process keeps the ids of words that it
has met: most words of a corpus repeat, and only new ones go to the tokenizer.
A word of letters goes straight to the tokenizer's model, as normalising and
splitting leave it as it is; a letter word with one mark behind it is that word
and the mark; anything else takes the tokenizer's whole path. Strings of special
tokens in a text get these tokens' ids, as the tokenizer gives them.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np

#: Words that a worker process keeps (about 90 MB), and how many of the first seen,
#: the common ones mostly, stay when it drops the rest.
CACHE_WORDS, CACHE_LEAST = 400_000, 120_000
MARKS = frozenset(".,;:!?")
SPECIAL = b"<|"  # a special token's string begins so


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves, others as U+0100 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


class WordEncoder(dict):
    """Word (lower-cased bytes) -> row in the table of ids."""

    def __init__(self, tokenizer_path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.letters = _byte_letters()
        self.marks = {m: self.whole(m) for m in MARKS}
        self.flat, self.first, self.length = array("I"), array("q"), array("q")

    def shrink(self) -> None:
        for key in list(self)[CACHE_LEAST:]:
            del self[key]
        # rows are numbered in the order of their words
        del self.flat[self.first[CACHE_LEAST] :], self.first[CACHE_LEAST:], self.length[CACHE_LEAST:]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def model(self, word: str) -> list[int]:
        if not word.isascii():
            if word.lower() != word or not unicodedata.is_normalized("NFC", word):
                return self.whole(word)
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def stays_letters(self, word: str) -> bool:
        """It is letters, and still is when it has been normalised."""
        return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", unicodedata.normalize("NFC", word).lower()).isalpha())

    def __missing__(self, key: bytes) -> int:
        word = key.decode("utf-8", "replace")
        if word.isalpha():
            ids = self.model(word)
        elif word[-1] in MARKS and self.stays_letters(word[:-1]):
            row = self[key[:-1]]
            ids = [*self.flat[self.first[row] : self.first[row] + self.length[row]], *self.marks[word[-1]]]
        else:
            ids = self.whole(word)
        self.first.append(len(self.flat))
        self.length.append(len(ids))
        self.flat.extend(ids)
        row = self[key] = len(self.first) - 1
        return row

    def encode(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), each text's followed by end_id, and the texts' offsets in them."""
        if len(self) > CACHE_WORDS:
            self.shrink()
        words: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = text.lower().split()
                if SPECIAL in text:  # case counts in a special token's string
                    own = [w if SPECIAL in w else w.lower() for w in text.split()]
                counts[i] = len(own)
                words += own
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        flat, first, length = (np.array(x) for x in (self.flat, self.first, self.length))
        lens = length[rows]
        ends = np.concatenate(([0], np.cumsum(lens)))
        source = np.repeat(first[rows] - ends[:-1], lens) + np.arange(ends[-1])
        upto = ends[np.cumsum(counts)]  # ids of words up to each text's end
        offsets = np.concatenate(([0], upto + np.arange(1, len(texts) + 1)))
        ids = np.empty(offsets[-1], np.uint32)
        keep = np.ones(offsets[-1], bool)
        keep[offsets[1:] - 1] = False
        ids[keep] = flat[source] if len(source) else 0
        ids[~keep] = end_id
        return ids, offsets


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_path: str) -> WordEncoder:
    """This worker process's encoder."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
    return _encoders[tokenizer_path]


def forget() -> None:
    """Drop this worker process's encoders: one process runs the tasks of all stages, and others need the memory."""
    _encoders.clear()


def id_width(tokenizer_path: str) -> str:
    """Little-endian type of ids between stages: two bytes where the vocabulary fits."""
    return "<u2" if encoder(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
