"""Token ids of whole texts by a public tokenizer that drops white space, a word at a time.

Such a tokenizer splits a text at white space before anything else, so the ids of a text are those of its words one
after the other. Words seen before come from a bounded memory of the Python worker; most others are put together from
their letters, digits and marks, and what is left goes to the tokenizer itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Characters that NFC leaves alone and whose lower case and class are the same in every Unicode version.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
#: The pattern of the tokenizer's own pre-tokenizer (fixed values), for those characters in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in set(_SHOWN)]
#: Byte-level BPE writes each byte as a character: itself if it can be shown, else the next one from 256 on.
_AS_CHAR = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


class WordTokenizer:
    def __init__(self, path: str, words: int = 150_000, pieces: int = 150_000) -> None:
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.most_words, self.most_pieces = words, pieces

    def ids(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit numbers, without special tokens around it."""
        if b"<|" in text and any(s in text for s in self.special):  # these match across white space
            return self._by_tokenizer(text)
        words = text.split()  # at ASCII white space
        found = list(map(self.words.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.words.get(words[i]) or self._word(words[i])
        return b"".join(found)

    def _by_tokenizer(self, text: bytes) -> bytes:
        return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            out = b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECES.findall(text.lower())])
        else:
            out = self._by_tokenizer(word)
        if len(self.words) < self.most_words and len(word) <= 64:
            self.words[word] = out
        return out

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([_AS_CHAR[b] for b in piece.encode()])
        out = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        if len(self.pieces) < self.most_pieces and len(piece) <= 64:
            self.pieces[piece] = out
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which Spark reuses from task to task."""
    return WordTokenizer(path)
