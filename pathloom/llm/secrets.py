"""Secrets in texts: fixed patterns, and tokens that pass a battery of randomness tests.

A token is a run of letters, digits and ``+ / _ -`` outside the patterns' matches. Its encoding is the smallest alphabet that holds it. Three tests
ask whether it may be drawn evenly from that alphabet: chi-squared of its characters, the number of runs in the lower and upper half of the alphabet,
and the correlation of neighbours. Fisher's method joins them, and a token whose joint p-value is below ``ALPHA`` is not random.

What is left may still be an ordinary word that is too short to tell. How ordinary tokens score is simulated for each encoding and length, by a
Markov chain over the pairs of neighbouring characters in the short words of the whole corpus. The share of simulated tokens that look as random as the
token is its p-value, and in each encoding and class of length the procedure of Benjamini and Hochberg holds the share of false finds below ``FDR``. So
the shorter a token and the more ordinary ones of its kind the corpus has, the more random it must look.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.text import bound_batches, plain, releasing, row_groups

# The patterns, the least length of a match (of its second group, for assignments), the order of the kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

LEAST_TOKEN = 16
ALPHA = 0.001
FDR = 0.01
SIMULATED = 10_000
# Tokens are compared with simulated ones of the length at the lower end of their class, which look no less random.
LENGTHS = (16, 20, 24, 28, 32, 40, 48, 64, 96, 128)

_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets in the order in which they are tried.
ENCODINGS = {
    "hex": _DIGITS + _LETTERS[:6], "upper hex": _DIGITS + _LETTERS[:6].upper(), "letters": _LETTERS, "upper letters": _LETTERS.upper(),
    "base32": _LETTERS.upper() + _DIGITS[2:8], "base36": _DIGITS + _LETTERS, "upper base36": _DIGITS + _LETTERS.upper(),
    "base62": _DIGITS + _LETTERS.upper() + _LETTERS, "base64": _LETTERS.upper() + _LETTERS + _DIGITS + "+/",
    "base64url": _LETTERS.upper() + _LETTERS + _DIGITS + "-_",
}
_NAMES = list(ENCODINGS)
# Characters of the Markov chain.
_CHARACTERS = ENCODINGS["base62"] + "+/-_"

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
# Greedy runs, of which short ones are dropped: the same as runs of a least length.
_ACCESS = re.compile(f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}")
_HEX = re.compile(f"[0-9a-f]{{{LEAST_HEX},}}")
_TOKEN = re.compile(f"[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}")
# A text without any of these has no match. The third one is in every match of the patterns for access, hex and tokens.
_MAY_ASSIGN = "(?i)password|passwd|secret|token|api_?key"
_MAY_RUN = f"[A-Za-z0-9+/_-]{{{LEAST_TOKEN}}}"

# Fisher's statistic is kept in steps; from the last one on the battery rejects.
_STEP = 0.05


def _fisher_tail(s: np.ndarray) -> np.ndarray:
    """Upper tail of chi-squared with six degrees of freedom."""
    return np.exp(-s / 2) * (1 + s / 2 + s * s / 8)


REJECTED = next(b for b in range(10_000) if _fisher_tail(np.float64(b * _STEP)) < ALPHA)

_tail = np.frompyfunc(lambda z: 0.5 * math.erfc(z / math.sqrt(2)), 1, 1)


def _log_tail(z: np.ndarray) -> np.ndarray:
    """Logarithm of the normal upper tail."""
    return np.log(np.maximum(_tail(z).astype(np.float64), 1e-300))


def battery(codes: np.ndarray, size: int) -> np.ndarray:
    """Fisher's statistic of each row of ``codes``, numbers below the even ``size``: the larger, the less random."""
    rows, length = codes.shape
    counts = np.bincount((codes + np.arange(rows)[:, None] * size).ravel(), minlength=rows * size).reshape(rows, size)
    freedom = size - 1
    square = (counts * counts).sum(axis=1) * size / length - length
    shape = 2 / (9 * freedom)
    uniform = ((square / freedom) ** (1 / 3) - (1 - shape)) / math.sqrt(shape)
    high = codes >= size // 2
    runs = ((high[:, 1:] != high[:, :-1]).sum(axis=1) - (length - 1) / 2) / (math.sqrt(length - 1) / 2)
    centred = codes - (size - 1) / 2
    serial = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / ((size * size - 1) / 12 * math.sqrt(length - 1))
    return -2 * (_log_tail(uniform) + 2 * math.log(2) + _log_tail(np.abs(runs)) + _log_tail(np.abs(serial)))


def steps(statistic: np.ndarray) -> np.ndarray:
    """The step of a statistic, ``REJECTED`` at most."""
    return np.minimum(statistic / _STEP, REJECTED).astype(np.int64)


_LOOKUP = {}
for _name, _alphabet in ENCODINGS.items():
    _LOOKUP[_name] = np.full(128, -1, np.int64)
    _LOOKUP[_name][[ord(c) for c in _alphabet]] = np.arange(len(_alphabet))
_CHAIN = np.full(256, -1, np.int64)
_CHAIN[[ord(c) for c in _CHARACTERS]] = np.arange(len(_CHARACTERS))


def encoding_of(token: str) -> int | None:
    """The number of the smallest alphabet that holds a token; None for digits alone and where none does."""
    if token.isdigit():
        return None
    used = set(token)
    return next((n for n, alphabet in enumerate(ENCODINGS.values()) if used <= set(alphabet)), None)


def length_class(length: int) -> int:
    return sum(length >= low for low in LENGTHS) - 1


def base_spans(text: str, assign: bool = True, runs: bool = True) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the patterns' matches. ``assign`` and ``runs`` tell whether there may be any."""
    found = []
    if assign:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if runs:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _tokens(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, str]]:
    """``start, end, encoding, token`` of the tokens that lie in no match of a pattern."""
    at, covered = 0, 0
    for match in _TOKEN.finditer(text):
        start, end = match.span()
        while at < len(base) and base[at][0] <= start:
            covered = max(covered, base[at][2])
            at += 1
        if end <= covered:
            continue
        encoding = encoding_of(match.group())
        if encoding is not None:
            yield start, end, encoding, match.group()


def _scored(tokens: list[tuple[int, str]]) -> dict[tuple[int, str], int]:
    """The step of each different ``encoding, token``."""
    kinds: dict[tuple[int, int], list[str]] = {}
    for encoding, token in set(tokens):
        kinds.setdefault((encoding, len(token)), []).append(token)
    out = {}
    for (encoding, length), own in kinds.items():
        name = _NAMES[encoding]
        each = max(1, (1 << 20) // length)
        for first in range(0, len(own), each):
            part = own[first:first + each]
            codes = _LOOKUP[name][np.frombuffer("".join(part).encode(), np.uint8)].reshape(len(part), length)
            out.update(((encoding, token), step) for token, step in zip(part, steps(battery(codes, len(ENCODINGS[name]))).tolist()))
    return out


def _scan(texts: pa.Array) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int, str]]]]:
    """Per text the patterns' spans and the tokens."""
    may_assign = pc.match_substring_regex(texts, _MAY_ASSIGN).to_numpy(zero_copy_only=False)
    may_run = pc.match_substring_regex(texts, _MAY_RUN).to_numpy(zero_copy_only=False)
    spans: list = [[] for _ in range(len(texts))]
    tokens: list = [[] for _ in range(len(texts))]
    for row in np.flatnonzero(may_assign | may_run).tolist():
        text = texts[row].as_py()
        spans[row] = base_spans(text, may_assign[row], may_run[row])
        if may_run[row]:
            tokens[row] = list(_tokens(text, spans[row]))
    return spans, tokens


def _pairs(texts: pa.Array) -> np.ndarray:
    """How often each pair of characters stands together in the runs below ``LEAST_TOKEN``."""
    size = len(_CHARACTERS)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    codes = _CHAIN[data]
    inside = codes >= 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets - offsets[0]] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])[:len(data)]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False)[:len(data)])) + 1
    short = np.zeros(len(data) + 1, np.int32)
    ordinary = ends - starts < LEAST_TOKEN
    np.add.at(short, starts[ordinary], 1)
    np.add.at(short, ends[ordinary], -1)
    within = np.cumsum(short[:-1]) > 0
    pair = within[1:] & within[:-1] & ~edge[1:-1]
    return np.bincount(codes[:-1][pair] * size + codes[1:][pair], minlength=size * size)


def corpus_statistics(docs: DataFrame) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
    """From all texts: counts of pairs of characters, and per encoding and class of length how many tokens have each step."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(len(_CHARACTERS) ** 2, np.int64)
        tokens: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            texts = plain(batch.column(0))
            for start, stop in row_groups(texts):
                part = texts.slice(start, stop - start)
                pairs += _pairs(part)
                found = [(encoding, token) for own in _scan(part)[1] for _, _, encoding, token in own]
                step_of = _scored(found)
                for encoding, token in found:
                    counts = tokens.setdefault((encoding, length_class(len(token))), np.zeros(REJECTED + 1, np.int64))
                    counts[step_of[encoding, token]] += 1
        kept = np.flatnonzero(pairs)
        rows = [(-1, 0, code, n) for code, n in zip(kept.tolist(), pairs[kept].tolist())]
        rows += [(encoding, length, step, int(counts[step])) for (encoding, length), counts in tokens.items() for step in np.flatnonzero(counts).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["encoding", "length", "step", "n"])

    bound_batches(docs.sparkSession)
    # At most one row for each pair of characters and for each encoding, class and step, whatever the corpus.
    found = docs.selectExpr("cast(text as string) text").mapInArrow(releasing(work), "encoding long, length long, step long, n long")
    pairs, tokens = np.zeros(len(_CHARACTERS) ** 2, np.int64), {}
    for row in found.groupBy("encoding", "length", "step").agg(F.sum("n").alias("n")).collect():
        if row["encoding"] < 0:
            pairs[row["step"]] = row["n"]
        else:
            tokens.setdefault((row["encoding"], row["length"]), np.zeros(REJECTED + 1, np.int64))[row["step"]] = row["n"]
    return pairs.reshape(len(_CHARACTERS), -1), tokens


def simulate(pairs: np.ndarray, alphabet: str, length: int, rows: int = SIMULATED, seed: int = 1) -> np.ndarray:
    """Codes of ``rows`` ordinary tokens: a Markov chain over the pairs of an alphabet's characters in the corpus."""
    own = [_CHARACTERS.index(c) for c in alphabet]
    counts = pairs[np.ix_(own, own)] + 0.5 / len(own)
    steady = np.cumsum(counts.sum(axis=1) / counts.sum())
    onward = np.cumsum(counts / counts.sum(axis=1, keepdims=True), axis=1)
    draw = np.random.default_rng(seed)
    last = len(own) - 1
    codes = np.empty((rows, length), np.int64)
    codes[:, 0] = np.minimum(np.searchsorted(steady, draw.random(rows)), last)
    for place in range(1, length):
        codes[:, place] = np.minimum((onward[codes[:, place - 1]] < draw.random(rows)[:, None]).sum(axis=1), last)
    return codes


def limits(pairs: np.ndarray, tokens: dict[tuple[int, int], np.ndarray], fdr: float = FDR) -> dict[tuple[int, int], int]:
    """Per encoding and class of length the first step that is no find any more."""
    out = {}
    for encoding in sorted({encoding for encoding, _ in tokens}):
        name = _NAMES[encoding]
        codes = simulate(pairs, ENCODINGS[name], max(LENGTHS[length] for e, length in tokens if e == encoding))
        for length in sorted(length for e, length in tokens if e == encoding):
            ordinary = np.bincount(steps(battery(codes[:, :LENGTHS[length]], len(ENCODINGS[name]))), minlength=REJECTED + 1)
            p = (1 + np.cumsum(ordinary)) / (1 + len(codes))
            counts = tokens[encoding, length]
            found = np.cumsum(counts)
            good = np.flatnonzero(p[:REJECTED] * counts.sum() <= fdr * found[:REJECTED])
            out[encoding, length] = int(good[-1]) + 1 if len(good) else 0
    return out


def scan_secrets(docs: DataFrame, *, fdr: float = FDR) -> DataFrame:
    """Secrets in ``docs (doc_id, text)``; other columns are ignored.

    Spans count code points, the end is exclusive. Kinds are, in this order: ``assign, access, hex``, found by the patterns (leftmost matches that do
    not overlap; too short ones are dropped), and ``random``, tokens that the battery finds and that lie in no match of a pattern. A null text is
    empty and has no spans; repeated rows are scanned each. Returns ``doc_id, n_assign, n_access, n_hex, n_random, base_sha256`` (SHA-256 in hexadecimal
    digits of the patterns' spans ``kind:start:end``, by start, then kind, joined by commas) and ``spans`` (all spans, joined likewise). An
    empty table gives an empty one.
    """
    known = limits(*corpus_statistics(docs), fdr)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), plain(batch.column(1))
            for start, stop in row_groups(texts):
                spans, tokens = _scan(texts.slice(start, stop - start))
                step_of = _scored([(encoding, token) for own in tokens for _, _, encoding, token in own])
                rows = []
                for base, own in zip(spans, tokens):
                    more = [(a, 3, b) for a, b, encoding, token in own if step_of[encoding, token] < known.get((encoding, length_class(len(token))), 0)]
                    named = [f"{KINDS[kind]}:{a}:{b}" for a, kind, b in base]
                    everything = [f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(base + more)] if more else named
                    counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                    rows.append((*counts, len(more), hashlib.sha256(",".join(named).encode()).hexdigest(), ",".join(everything)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, stop - start), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        releasing(work), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
