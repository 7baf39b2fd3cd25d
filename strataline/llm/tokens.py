"""Word-cached encoding with the tokenizers library.

The tokenizer normalises, splits into words and runs BPE inside each word, so the ids of a text are the
ids of its words in order. Texts of a plain character range are split here and each distinct word is sent
to the library's BPE model once per worker; other texts go to the library whole, cut only at ASCII white
space, which no word, special token or composed character spans.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCAB = "word_bpe_49k.json"
#: Characters on which lower-casing, composition and letter classes are beyond doubt.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\s0-9a-zà-öø-ÿß]+")
CHUNK = re.compile(r"[^\t\n\r ]+")
#: Distinct words kept by a worker before its cache starts anew (about 50 MB).
CACHE_WORDS = 250_000


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of the byte-level alphabet: byte -> character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """word -> little-endian uint32 ids as bytes, filled on demand by the library."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        found = self[word] = np.array(ids, "<u4").tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """All ids of a text, as bytes of little-endian uint32."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, WORD.findall(text.lower())))
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(CHUNK.findall(text), add_special_tokens=False)]
        return np.array([i for x in ids for i in x], "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path or public_tokenizers.path(VOCAB))
