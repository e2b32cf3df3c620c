import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import secrets
from tests.llm.conftest import rows_of, words

BASE62 = secrets.ENCODINGS["base62"]


def slow_base(text):
    """All matches of the patterns as they stand, short ones dropped."""
    found = []
    for kind, (pattern, flags, long_enough) in enumerate([
        (secrets.ASSIGN, re.A | re.I, lambda m: len(m.group(2)) >= 8), (secrets.ACCESS, re.A, lambda m: len(m.group()) >= 16),
        (secrets.HEX, re.A, lambda m: len(m.group()) >= 32),
    ]):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if long_enough(m)]
    return sorted(found)


def slow_statistic(token, alphabet):
    codes, m, n = [alphabet.index(c) for c in token], len(alphabet), len(token)
    x = sum((codes.count(c) - n / m) ** 2 / (n / m) for c in range(m))
    k = m - 1
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    changes = sum((a >= m / 2) != (b >= m / 2) for a, b in zip(codes, codes[1:]))
    runs = (changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    serial = sum((a - (m - 1) / 2) * (b - (m - 1) / 2) for a, b in zip(codes, codes[1:])) / ((m * m - 1) / 12) / math.sqrt(n - 1)
    tail = lambda v: 0.5 * math.erfc(v / math.sqrt(2))
    return -2 * (math.log(tail(z)) + math.log(2 * tail(abs(runs))) + math.log(2 * tail(abs(serial))))


def slow_scan(texts):
    """Spans of every text, straight from the definitions, given the simulated ordinary tokens."""
    size = len(secrets._CHARACTERS)
    pairs, tokens = np.zeros((size, size), int), []
    for row, text in enumerate(texts):
        base = slow_base(text)
        for run in re.finditer(r"[A-Za-z0-9+/_-]+", text):
            if len(run.group()) < 16:
                for a, b in zip(run.group(), run.group()[1:]):
                    pairs[secrets._CHARACTERS.index(a), secrets._CHARACTERS.index(b)] += 1
            elif not any(a <= run.start() and run.end() <= b for a, _, b in base) and not run.group().isdigit():
                name = next((n for n, alphabet in secrets.ENCODINGS.items() if set(run.group()) <= set(alphabet)), None)
                if name is not None:
                    length = max(low for low in secrets.LENGTHS if low <= len(run.group()))
                    tokens.append((row, run.start(), run.end(), name, length, int(min(slow_statistic(run.group(), secrets.ENCODINGS[name]) / 0.05, secrets.REJECTED))))
    found = {row: slow_base(text) for row, text in enumerate(texts)}
    for name, length in {t[3:5] for t in tokens}:
        longest = max(t[4] for t in tokens if t[3] == name)
        codes = secrets.simulate(pairs, secrets.ENCODINGS[name], longest)[:, :length]
        ordinary = secrets.steps(secrets.battery(codes, len(secrets.ENCODINGS[name])))
        own = [t for t in tokens if t[3:5] == (name, length)]
        p = [1.0 if t[5] >= secrets.REJECTED else (1 + int((ordinary <= t[5]).sum())) / (1 + len(codes)) for t in own]
        # Benjamini and Hochberg: the largest p-value that its rank allows, and all below it.
        allowed = [x for rank, x in enumerate(sorted(p), 1) if x <= secrets.FDR * rank / len(p)]
        for t, x in zip(own, p):
            if allowed and x <= max(allowed):
                found[t[0]] = sorted([*found[t[0]], (t[1], 3, t[2])])
    return [",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found[row]) for row in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    draw = lambda n, alphabet: "".join(pick.choice(alphabet) for _ in range(n))
    prose = lambda: " ".join(pick.choice(["management", "thing", "other", "understanding", "the", "of", "Report", "value", "2024", "system"]) for _ in range(60))
    out = []
    for i in range(60):
        middle = [
            draw(32, BASE62), f"key {draw(40, secrets.ENCODINGS['base64'])}==", f'Password = "{draw(12, BASE62)}"', f"API_KEY:{draw(6, BASE62)}", "AKIA" + draw(16, "ABCDEFGHIJ234567"),
            draw(40, "0123456789abcdef"), "internationalizationofunderstanding", "thisIsAnOrdinaryIdentifierOfManyWords", "a" * 40, "abcdefghijklmnopqrstuvwxyz0123456789",
            "the/path/of/ordinary/things/report", "AKIA1234", "tokeN=abc token=token=12345678 ſecret=12345678", "1234567890123456789012",
        ][i % 14]
        out.append(f"{prose()} é日🙂 {middle}. {prose()}")
    return out


def test_finds_random_tokens_and_no_ordinary_ones(spark, texts):
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    for i in range(len(texts)):
        expected = 1 if i % 14 in (0, 1) else 0
        assert rows[i]["n_random"] == expected, (i, texts[i], rows[i])
    assert [rows[i]["n_assign"] for i in (2, 3, 12)] == [1, 0, 1] and rows[4]["n_access"] == rows[5]["n_hex"] == 1 and rows[11]["n_access"] == 0


def test_against_slow_form(spark, texts):
    odd = [*texts, "", " ", "secret", "token:" + "x" * 70_000, words(20_000, 3), texts[0], texts[0], "0" * 31, "0" * 32, "AKIA" * 5]
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(5)).collect()}
    slow = slow_scan(odd)
    for i, text in enumerate(odd):
        base = slow_base(text)
        named = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert rows[i]["spans"] == slow[i]
        assert rows[i]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert [rows[i]["n_assign"], rows[i]["n_access"], rows[i]["n_hex"]] == [sum(k == n for _, k, _ in base) for n in range(3)]


def test_statistic():
    pick = random.Random(1)
    for name, alphabet in secrets.ENCODINGS.items():
        for length in (16, 33, 200):
            token = "".join(pick.choice(alphabet) for _ in range(length))
            codes = np.array([[alphabet.index(c) for c in token]])
            assert secrets.battery(codes, len(alphabet))[0] == pytest.approx(slow_statistic(token, alphabet))


def test_false_finds_stay_below_the_rate():
    """Ordinary tokens alone: as good as none may be found, at any length."""
    pairs = np.zeros((len(secrets._CHARACTERS),) * 2, int)
    draw = np.random.default_rng(3)
    for _ in range(2000):
        a, b = draw.integers(10, 62, 2)
        pairs[a, b] += int(draw.integers(1, 40) ** 2)
    alphabet = secrets.ENCODINGS["base62"]
    own = secrets._NAMES.index("base62")
    for length, low in enumerate(secrets.LENGTHS[:6]):
        tokens = secrets.steps(secrets.battery(secrets.simulate(pairs, alphabet, low, 5000, seed=99), 62))
        counts = np.bincount(tokens, minlength=secrets.REJECTED + 1)
        limit = secrets.limits(pairs, {(own, length): counts})[own, length]
        assert counts[:limit].sum() <= 5


def test_odd_rows(spark, odd_docs, odd_rows):
    found = rows_of(secrets.scan_secrets(odd_docs), "doc_id", "n_assign", "spans")
    assert len(found) == len(odd_rows)
    slow = slow_scan([text or "" for _, text, *_ in odd_rows])
    assert [s for _, _, s in found] == [s for _, s in sorted(zip([r[0] for r in odd_rows], slow), key=lambda r: repr((r[0], 0, r[1])))]


def test_nothing(spark, no_docs):
    assert secrets.scan_secrets(no_docs).collect() == []


def test_pairs_do_not_cross_texts():
    pairs = secrets._pairs(pa.array(["ab", "c", "", "d" * 16 + " ef"]))
    at = {c: i for i, c in enumerate(secrets._CHARACTERS)}
    assert pairs.sum() == 2 and pairs[at["a"] * 66 + at["b"]] == 1 and pairs[at["e"] * 66 + at["f"]] == 1


