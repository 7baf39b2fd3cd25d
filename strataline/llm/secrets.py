"""Operator 7: secret scans by sliding-window Shannon entropy.

Three patterns of known forms (assign, access, hex) and, beside them, an entropy scan: candidate strings are
maximal runs of token characters; each character class keeps counts over a sliding window, updated by one
character in and one out, and the windows whose entropy passes the class's threshold are joined to spans of
kind ``entropy``. Candidates on an allow list (words, hyphenated or dotted words, paths, addresses of web
pages up to their query part, numbers, runs of one character, base spans) are suppressed. Without a digit, letters of one case count as words,
and letters of both where the pieces of their camel case are WORDY letters long in the mean; others are tested.

Null texts are empty; null doc_ids, repeated rows and an empty table go through as they are; texts of any length
are read whole, and only joined spans of one are held; columns other than the id and the text are ignored,
whatever their names. Offsets are code points with exclusive ends.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, deque
from functools import lru_cache
from hashlib import sha256
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, keyed, pieces

#: Fixed patterns; ASCII letters of the keywords in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGNED = 6
#: Entropy scan: window, and for each class its characters, those that may lie between them, and the bits that a window must reach.
WINDOW = 20
CLASSES = (
    ("hexadecimal", frozenset("0123456789abcdefABCDEF"), "-", 3.0),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), "", 3.9),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
#: Addresses up to their query part, in which candidates are suppressed.
ADDRESS = re.compile(r"""(?:[A-Za-z][A-Za-z0-9+.-]*://|www\.)[^\s"'<>?#]+""")
#: Allow list: dotted, slashed or hyphenated words of small letters, numbers and dates, runs of one character; and see wordlike.
ALLOWED = re.compile(r"[a-z]+(?:[-_/=+][a-z]+)*|[0-9_+/=-]+|(.)\1+", re.DOTALL)
#: Pieces of camel case, and the letters that one has in the mean at least in words (in random letters 2.7).
PIECE, WORDY = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), 3.5


@lru_cache(maxsize=1)
def plogp(window: int = WINDOW) -> tuple[float, ...]:
    return tuple(c / window * log2(c / window) if c else 0.0 for c in range(window + 1))


def wordlike(run: str) -> bool:
    """Whether a run without digits reads as words or none at all: letters of one case, or long pieces of camel case."""
    pieces = PIECE.findall(run)
    return run.islower() or run.isupper() or sum(map(len, pieces)) >= WORDY * len(pieces)


def windows(run: str, members: frozenset[str], skipped: str, bits: float):
    """From and to of the windows of WINDOW characters of the class that reach the bits; skipped characters lie inside, others end a window."""
    table, counts, held, total = plogp(), Counter(), deque(), 0.0  # total: minus the entropy of the window
    for k, c in enumerate(run):
        if c in skipped:
            continue
        if c not in members:
            counts.clear()
            held.clear()
            total = 0.0
            continue
        if len(held) == WINDOW:
            _, gone = held.popleft()
            total += table[counts[gone] - 1] - table[counts[gone]]
            counts[gone] -= 1
        total += table[counts[c] + 1] - table[counts[c]]
        counts[c] += 1
        held.append((k, c))
        if len(held) == WINDOW and -total >= bits - 1e-9:
            yield held[0][0], k + 1


def joined_spans(spans):
    """Spans in order of their starts, those that meet as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Joined windows of high entropy inside candidates that the allow list does not suppress."""
    spans: list[tuple[int, int]] = []
    addresses = joined_spans(m.span() for m in ADDRESS.finditer(text)) if "://" in text or "www." in text else []
    for m in CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        if ALLOWED.fullmatch(run) or not any(c.isalpha() for c in run) or (not any(c.isdigit() for c in run) and wordlike(run)):
            continue
        k = bisect_right(addresses, (at, len(text))) - 1
        if k >= 0 and at < addresses[k][1]:
            continue
        found = [x for _, members, skipped, bits in CLASSES for x in joined_spans(windows(run, members, skipped, bits))]
        spans += [(at + s, at + e) for s, e in joined_spans(sorted(found))]
    return spans


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then by kind as listed."""
    found = []
    if KEYWORD.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = found[:]
    found += [("entropy", s, e) for s, e in entropy_spans(text) if not any(a <= s and e <= b for _, a, b in base)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by the mark."""
    out, at = [], 0
    for _, s, e in scan(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans (kind, start, end) of every row."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in pieces(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches):
        for b in pieces(batches):
            rows = []
            for spans in b.column(1).to_pylist():
                spans = [(x["kind"], x["start"], x["end"]) for x in spans]
                base = [x for x in spans if x[0] != "entropy"]
                rows.append((*(sum(x[0] == k for x in base) for k in KINDS[:3]), sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(cols))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return find_secrets(documents(spark, sf_dir)).mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
