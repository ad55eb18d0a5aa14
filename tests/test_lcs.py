"""Bit-parallel longest common subsequences against the plain recurrence."""

import random
import time

import pytest

from caseflow.operators import hooks


def plain(p, q):
    row = [0] * (len(q) + 1)
    for c in p:
        last = 0
        for k, d in enumerate(q, 1):
            last, row[k] = row[k], last + 1 if c == d else max(row[k], row[k - 1])
    return row[-1]


def test_equals_the_recurrence():
    rng = random.Random(1)
    pairs, want = [], []
    for _ in range(3000):
        letters = rng.choice(["ab", "abcdefgh", "AÇ日𝒳 "])
        p, q = ("".join(rng.choices(letters, k=rng.randrange(rng.choice([3, 40, 150])))) for _ in range(2))
        n = plain(p, q)
        assert hooks.lcs_length(p, q) == n
        pairs.append((p, q))
        want.append(2 * n / (len(p) + len(q)) if p or q else 1.0)
    for least in (0.0, 0.5, 0.9):
        assert hooks._lcs_scores(*map(list, zip(*pairs)), least).tolist() == [w if w >= least else 0.0 for w in want]
    long = ["".join(rng.choices("abc", k=n)) for n in (1023, 1024, 1500, 64, 128)]
    assert hooks.lcs_lengths(long, long[::-1]).tolist() == [plain(p, q) for p, q in zip(long, long[::-1])]


def test_partial_is_the_best_window():
    rng = random.Random(2)
    for _ in range(400):
        p, q = ("".join(rng.choices("abcx", k=rng.randrange(1, 14))) for _ in range(2))
        s, t = sorted((p, q), key=len) if len(p) != len(q) else (p, q)
        windows = [t[max(0, e - len(s)) : e] for e in range(1, len(t) + len(s))]
        want = max(2 * plain(s, w) / (len(s) + len(w)) for w in windows)
        for least in (0.0, 0.7):
            assert hooks._partial_score(p, q, least) == pytest.approx(want if want >= least else 0.0)


def test_speed_at_two_hundred_letters():
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choices("abcdefghijklmnopqrst", k=200)) for _ in range(2)) for _ in range(2000)]
    began = time.perf_counter()
    want = [plain(p, q) for p, q in pairs[:8]]
    slow = (time.perf_counter() - began) / 8
    began = time.perf_counter()
    got = hooks.lcs_lengths(*map(list, zip(*pairs)))
    fast = (time.perf_counter() - began) / len(pairs)
    assert got[:8].tolist() == want and slow > 50 * fast


def test_column(spark):
    rows = spark.createDataFrame([("Ação", "acao"), ("abcd", "xbxd"), (None, ""), ("abc", None), ("bolt", "a red bolt here")], "a string, b string")
    assert [round(r["lcs"], 3) for r in hooks.lcs_ratio(rows).collect()] == [1.0, 0.5, 1.0, 0.0, 0.421]
    assert [round(r["lcs"], 3) for r in hooks.lcs_ratio(rows, partial=True).collect()] == [1.0, 0.571, 1.0, 0.0, 1.0]
