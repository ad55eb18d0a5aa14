"""Exact copies and fill-in-middle against SQL, importance against plain code, and the edge rows of all three."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from caseflow.llm import exact_dedup, fill_in_middle, importance
from caseflow.llm._common import steps
from conftest import same_as_sql

DOCS = "doc_id long, text string, unit string, row string, digest string, rank int, `__text` string, `__id` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "u", "r", "d", 7, "x", 1) for i, t in rows], DOCS)


EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two  three"), (5, "onetwo three"), (6, "one two  three"), (6, "one two  three"), (None, "ONE"), (None, None), (7, "é a b"), (8, "éa b"), (9, "<P> mark"),
    (10, "word " * 40_000), (11, "a\x0bb"), (12, "ab\x1c"), (13, " lead"), (14, "tail \r\n"), (15, "𝒳𝒴 ünï 日本語 x"), (None, "ONE"),
]


# ---- exact copies


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_copies_of_the_table(spark, sf_dir):
    assert same_as_sql(spark, exact_dedup.query, exact_dedup.ORACLE, sf_dir)


def plain_copies(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for bare, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        out += [(None if m[1] else m[2], keep, len(members), hashlib.sha256(bare.encode()).hexdigest()) for m in members]
    return sorted(out, key=str), sorted((rows[min(m)[3]] for m in groups.values()), key=str)


@pytest.mark.parametrize("settings", [exact_dedup.Settings(), exact_dedup.Settings(unit_rows=3, owner_rows=4, units_in_folder=2), exact_dedup.Settings(unit_rows=2, spare_bits=-12)])
def test_copies_of_edge_rows(spark, settings):
    rng = random.Random(4)
    rows = EDGES + [(100 + k, rng.choice(["hot text", "hottext", f"{k % 9} cold", f"{k}"])) for k in range(200)]
    want, stay = plain_copies(rows)
    df = frame(spark, rows).repartition(5)
    got = exact_dedup.exact_copies(df, settings=settings).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = exact_dedup.drop_copies(df, settings=settings)
    assert kept.columns == df.columns
    texts = kept.collect()
    assert len(texts) == len(stay) == sum(r.kept for r in got)
    assert sorted(((r.doc_id, r.text) for r in texts), key=str) == stay


def test_no_copies_of_nothing(spark):
    assert exact_dedup.exact_copies(frame(spark, [])).count() == 0
    assert exact_dedup.drop_copies(frame(spark, [])).count() == 0


def test_golomb_code():
    rng = np.random.default_rng(1)
    for universe, n in ((1, 1), (50, 50), (1 << 16, 40), (1 << 16, 30_000), (1 << 62, 1000), (10, 0), (1 << 40, 1)):
        values = np.unique(rng.integers(0, universe, n)) if n < universe else np.arange(universe)
        coded = exact_dedup.golomb_encode(values, universe)
        assert exact_dedup.golomb_decode(coded, len(values)).tolist() == values.tolist()
    values = np.unique(rng.integers(0, 1 << 40, 60_000))
    bits = 8 * len(exact_dedup.golomb_encode(values, 1 << 40)) / len(values)
    assert bits < math.log2((1 << 40) / len(values)) + 2  # the entropy is about 1.44 above the log


def test_texts_with_one_fingerprint_are_told_apart(spark):
    """With 16 bits of fingerprint 3,000 texts share some: all are suspects, none is a copy."""
    rows = [(k, f"text {k}") for k in range(3000)]
    plan = exact_dedup.planned(len(rows), 4, exact_dedup.Settings(spare_bits=-30))
    prints = exact_dedup.fingerprints([hashlib.sha256(t.replace(" ", "").encode()).digest() for _, t in rows], plan.bits)
    assert len(set(prints.tolist())) < len(rows)
    got = exact_dedup.exact_copies(frame(spark, rows), settings=exact_dedup.Settings(spare_bits=-30))
    assert got.where("kept and group_size = 1 and keep_id = doc_id").count() == len(rows)


# ---- fill-in-middle


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_cuts_of_the_table(spark, sf_dir):
    assert same_as_sql(spark, fill_in_middle.query, fill_in_middle.ORACLE, sf_dir)


def plain_cut(i, t, s):
    t = t or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = fill_in_middle.draws(i, s.seed)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or h[2] % 100 >= s.rate or any(mark in t for mark in (s.prefix, s.suffix, s.middle)):
        return i, len(units), "plain", None, None, t, t
    if h[3] % 100 < s.suffix_first:
        return i, len(units), "spm", len(p), len(m), f"{s.suffix}{x}{s.prefix}{p}{s.middle}{m}", t
    return i, len(units), "psm", len(p), len(m), f"{s.prefix}{p}{s.suffix}{x}{s.middle}{m}", t


def test_cuts_of_edge_rows(spark):
    rng = random.Random(2)
    rows = EDGES + [(1000 + k, "".join(rng.choices(["a", "é", "日", "𝒳", " ", "\n", "\x0c", "\x85", " ", "<", "<S", "M>", "B", "9"], k=rng.randrange(40)))) for k in range(1500)]
    s = fill_in_middle.Settings(rate=90, suffix_first=50)
    got = fill_in_middle.reorder(frame(spark, rows).repartition(3), s).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_cut(i, t, s) for i, t in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.reorder(frame(spark, [])).count() == 0


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 6, n).astype(np.uint8)
        matrix = fill_in_middle.WaveletMatrix(symbols, 3)
        at = np.arange(n + 1)
        for c in range(6):
            assert matrix.rank(c, at).tolist() == [int((symbols[:k] == c).sum()) for k in at]


# ---- importance


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def plain_resample(docs, target, s):
    every = [(i, *plain_features(t)) for i, t in docs]
    corpus, wanted = [0] * s.buckets, [0] * s.buckets
    for f in (f for _, _, fs in every for f in fs):
        corpus[f % s.buckets] += 1
    for f in (f for t in target for f in plain_features(t)[1]):
        wanted[f % s.buckets] += 1
    a, b = sum(corpus), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (a + s.buckets) / ((c + 1) * (b + s.buckets)))) for c, t in zip(corpus, wanted)]
    rows = []
    for i, n_words, fs in every:
        weight = sum(gain[f % s.buckets] for f in fs)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n_words])
    able = sorted((r for r in rows if r[5] >= s.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: s.percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_importance_of_the_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    got = importance.query(spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target, importance.Settings())


def test_importance_of_edge_rows(spark):
    rng = random.Random(5)
    words = ["alpha", "BETA", "a1", "9", "été", "{x}", "z" * 300, "日本", "x\x7fy", "\x00q"]
    rows = EDGES + [(1000 + k, " ".join(rng.choices(words, k=rng.randrange(60)))) for k in range(400)] + [(2000, "same text " * 15), (2001, "same text " * 15), (2001, "same text " * 15)]
    target = ["alpha beta a1 9 été"] * 5 + [None, ""]
    s = importance.Settings(buckets=97, percent=40)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame(spark, rows).repartition(6), wanted, s).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows, target, s)
    assert importance.resample(frame(spark, []), wanted, s).count() == 0
    none = wanted.where("text is null")
    assert sorted(map(tuple, importance.resample(frame(spark, rows), none, s).collect()), key=str) == plain_resample(rows, [None], s)


def test_features_of_slices():
    texts = pa.array(["skip", "One two  three", None, "", "--", "two three four five", "one"])
    got = importance.Features(texts.slice(1), 1 << 31)
    every = [plain_features(t) for t in texts.to_pylist()[1:]]
    assert got.words.tolist() == [n for n, _ in every] and got.sizes().tolist() == [len(f) for _, f in every]
    assert sorted(np.concatenate(got.bucket).tolist()) == sorted(f % (1 << 31) for _, fs in every for f in fs)


def test_features_of_steps():
    """Every step of a batch of several; without nulls, which would have it copied, a step lies inside the batch's buffer."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Alpha", "bêta", "GAMMA-9", "日本"]) for _ in range(rng.randrange(400))) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [importance.Features(b.column("text"), 1 << 31) for b in steps(batch, "text", 100_000)]
    assert len(parts) > 5
    every = [plain_features(t) for t in texts]
    assert np.concatenate([p.words for p in parts]).tolist() == [n for n, _ in every]
    assert sorted(np.concatenate([b for p in parts for b in p.bucket]).tolist()) == sorted(f % (1 << 31) for _, fs in every for f in fs)
