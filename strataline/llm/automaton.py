"""Operator 6: BPE by a tokenization automaton.

The automaton reads tokens and accepts exactly the BPE tokenizations. It starts as one state that loops on
every base symbol, and each merge u v -> w adds its gadget: the state that u leads to is copied without its
v arc, arcs u lead to the copy, and every state with an arc u gets an arc w to where v leads. All arcs of a
label share a target, and a copy differs from its parent in one arc. So the copies made for one token
form a line that notes which arc it lost at which merge, a line starts from some state of another line, and
an arc test walks down the left parts of merges to the age of the state and looks the arc up among the
losses of the few lines above. Verdicts are kept in a transition table (state, token) -> bool.

A pre-split word is encoded by transitions only: from each state try the longest arc label that the word
goes on with, and step back when a state has none; the accepted path is unique. Decoding emits the labels of
the arcs. Words of one worker are cached up to a fixed number.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, keyed, pieces
from .tokens import PLAIN, VOCAB, WORD, byte_letters

#: Pre-tokenizer pattern of the vocabulary file (fixed value).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = regex.compile(r"\s+")
#: Distinct words kept by a worker before its cache starts anew (about 50 MB).
KEPT_WORDS = 150_000
#: Verdicts kept by a worker before its table starts anew.
TABLE_ARCS = 400_000


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.labels = {i: t for t, i in vocab.items()}
        self.suffix, n = suffix, max(vocab.values()) + 1
        self.born, self.left = [0] * n, [-1] * n  # token: the merge that made it, and the left part; 0 and -1 for base symbols
        self.target = [0] * n  # token: the state its arcs lead to
        self.state_line, self.made = [-1], [0]  # state: the line (token) it is of, made at merge
        self.losses: dict[int, dict[int, int]] = {-1: {}}  # line: arc -> merge at which the line lost it
        self.above: dict[int, tuple[int, int]] = {}  # line: the line and merge that it starts from
        for k, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if not self.arc(self.target[u], v):
                continue  # no path reads u v, so the merge never applies
            after, q = self.target[v], self.target[u]
            if u not in self.losses:
                self.losses[u], self.above[u] = {}, (self.state_line[q], self.made[q])
            self.losses[u][v] = k
            self.state_line.append(u)
            self.made.append(k)
            self.target[u] = len(self.made) - 1
            if self.left[w] < 0 and not self.born[w]:
                self.born[w], self.left[w], self.target[w] = k, u, after
        arcs = {i for i in vocab.values() if self.born[i] or len(self._symbols(self.labels[i])) == 1}
        self.words = {self.labels[i]: i for i in arcs}
        self.longest = max((len(self._symbols(t)) for t in self.words), default=1)
        self.table: dict[int, bool] = {}

    def _symbols(self, label: str) -> str:
        """The label with its end-of-word suffix as a part of the last symbol."""
        return label.removesuffix(self.suffix) if self.suffix and label != self.suffix else label

    def arc(self, state: int, token: int) -> bool:
        """Does the state have an arc of this token?"""
        lines, line, limit = [], self.state_line[state], self.made[state]
        while line >= 0:
            lines.append((self.losses[line], limit))
            line, limit = self.above[line]
        limit = self.made[state]
        while True:
            for lost, upto in lines:
                at = lost.get(token)
                if at is not None and at <= upto and at <= limit:
                    return False
            if self.left[token] < 0:
                return True
            limit = min(limit, self.born[token])
            token = self.left[token]  # the arc came with that of the left part

    def encode(self, word: str) -> list[int]:
        """The one accepted path that spells the word, or symbol by symbol, unknown ones left out, where the vocabulary lacks a symbol."""
        words, table, target, end = self.words, self.table, self.target, len(word)
        path: list[tuple[int, int, int]] = []  # token, where it starts, where it ends
        at, state, stop = 0, 0, min(end, self.longest)
        while at < end:
            found = -1
            for to in range(stop, at, -1):
                token = words.get(word[at:to] + self.suffix if to == end else word[at:to])
                if token is not None:
                    key = state << 20 | token
                    ok = table.get(key)
                    if ok is None:
                        if len(table) >= TABLE_ARCS:
                            table.clear()
                        ok = table[key] = self.arc(state, token)
                    if ok:
                        found = token
                        break
            if found >= 0:
                path.append((found, at, to))
                at, state = to, target[found]
                stop = min(end, at + self.longest)
            elif path:
                _, at, to = path.pop()
                state, stop = target[path[-1][0]] if path else 0, to - 1
            else:
                known = [c for k, c in enumerate(word) if (c + self.suffix if k == end - 1 else c) in words]
                if len(known) == end:
                    raise ValueError(f"no path for {word!r}")
                return [words[c] for c in known if c in words]
        return [t for t, _, _ in path]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.labels[i] for i in ids)


class Words(dict):
    """word -> (ids as bytes of little-endian uint32, emitted labels), filled by the automaton."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.labels |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.letters = byte_letters()
        for content, i in self.special.items():
            self[content, True] = (np.array([i], "<u4").tobytes(), content)

    def __missing__(self, word: str):
        if len(self) >= KEPT_WORDS:
            kept = {k: v for k, v in self.items() if isinstance(k, tuple)}
            self.clear()
            self.update(kept)
        ids = self.automaton.encode(word.encode().decode("latin-1").translate(self.letters))
        found = self[word] = (struct.pack(f"<{len(ids)}I", *ids), self.automaton.decode(ids))
        return found

    def split(self, text: str) -> list:
        """Normalised, pre-split words; special tokens as (content, True)."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return WORD.findall(text.lower())
        out, at = [], 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            part = unicodedata.normalize("NFC", text[at : m.start() if m else len(text)])
            out += SPLIT.findall("".join(map(str.lower, SPACES.sub(" ", part))))
            if m:
                out.append((m[0], True))
                at = m.end()
        return out


@lru_cache(maxsize=2)
def words_of(path: str | None = None) -> Words:
    return Words(path or public_tokenizers.path(VOCAB))


def encode_documents(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian uint32 as bytes) and decoded text of every row.

    Null texts are empty: no ids, decoded to the empty string. Null doc_ids and repeated rows stay as they are; an empty
    table gives an empty result; columns other than the id and the text are ignored, whatever their names; texts and
    words of any length are read whole.
    """

    def run(batches):
        words = words_of(vocab)
        for b in pieces(batches):
            ids, shown = [], []
            for text in b.column(1).to_pylist():
                found = list(map(words.__getitem__, words.split(text)))
                ids.append(b"".join([f[0] for f in found]))
                shown.append(" ".join([f[1] for f in found if f[1]]))
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array(shown, pa.string())], ["doc_id", "ids", "decoded"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches):
        for b in pieces(batches):
            ids, shown = b.column(1).to_pylist(), b.column(2).to_pylist()
            yield pa.record_batch(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha256(x).hexdigest() for x in ids]), pa.array([sha256(x.encode()).hexdigest() for x in shown])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encode_documents(documents(spark, sf_dir)).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
