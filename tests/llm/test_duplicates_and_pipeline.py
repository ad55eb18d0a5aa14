"""Repeats and near duplicates against brute force; the pipeline's stages, one by one."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import same_as_sql
from pyspark.sql import functions as F

from caseflow.llm import ngram_join, quality_rules, secret_scan, stages, suffix_dedup


def brute_repeats(rows, length=200):
    seen = {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc_id, _), raw in zip(rows, raws):
        hit = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                hit[p : p + length] = True
        runs = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        out.append((doc_id, len(raw), int(hit.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~hit].tobytes()).hexdigest()))
    return sorted(out, key=str)


def made_texts():
    r = random.Random(3)
    w = lambda n: "".join(r.choices("abcdefgh é\n", k=n))
    shared, longer = w(150), w(190)
    rows = [(k, w(300) + shared + w(200)) for k in range(40)] + [(100 + k, w(100) + longer + w(9 + k % 3)) for k in range(30)]
    rows += [(200, "a" * 900), (201, "ab" * 400), (201, "ab" * 400), (202, None), (203, ""), (None, "x" * 250), (204, "x" * 250 + "y"), (205, "z" * 199), (206, "z" * 199)]
    base = w(4000)
    return [*rows, (300, base), (301, base[1000:1400] + "zz" + base[1500:1699] + "é" + base[2000:2200])]


@pytest.mark.parametrize("settings", [suffix_dedup.Settings(), suffix_dedup.Settings(hot_classes=3, bucket_windows=500, batch_windows=100, piece_bytes=700)])
def test_repeats_equal_brute_force(spark, settings):
    rows = made_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cuts", F.lit(1)).withColumn("first", F.lit(2))
    found = suffix_dedup.measure_repeats(suffix_dedup.find_repeats(docs, settings)).collect()
    assert sorted(map(tuple, found), key=str) == brute_repeats(rows)


def test_repeats_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, suffix_dedup.query(spark, sf_dir).collect()), key=str) == brute_repeats(rows)


def test_family_merges_geometrically():
    family = suffix_dedup.SuffixFamily(4)
    for k in range(13):
        family.add(b"abcd%04d" % k, np.arange(5), np.zeros(5, bool))
    assert [level is not None for level in family.levels] == [True, False, True, True]  # 13 batches
    for level in filter(None, family.levels):
        suffixes = [level.text[p : p + 4] for p in level.places]
        assert suffixes == sorted(suffixes) and len(level.text) == 8 * len(level.places) // 5
    assert family.hit.reshape(13, 5)[:, 0].all()


def test_family_equals_counting():
    r, family, seen, every = random.Random(4), suffix_dedup.SuffixFamily(6), {}, []
    for _ in range(21):
        text = "".join(r.choices("ab", k=r.randint(6, 60))).encode()
        family.add(text, np.arange(len(text) - 5), np.zeros(len(text) - 5, bool))
        every += [text[p : p + 6] for p in range(len(text) - 5)]
    for w in every:
        seen[w] = seen.get(w, 0) + 1
    assert family.hit.tolist() == [seen[w] > 1 for w in every]


def test_common_prefixes():
    a, b = (np.array(x, "S4") for x in (["abcd", "abcd", "xbcd", "ab\0\0"], ["abcd", "abxd", "abcd", "ab\0x"]))
    assert suffix_dedup.common_prefixes(a, b, 4).tolist() == [4, 2, 0, 3]


def test_a_passage_in_very_many_texts(spark):
    r = random.Random(11)
    w = lambda n: "".join(r.choices("abcdefghij ", k=n))
    short, long = w(190), w(260)
    rows = [(k, w(120) + short + w(130)) for k in range(1500)] + [(5000 + k, w(120) + long + w(110)) for k in range(700)] + [(9000, w(20) + rows_tail(short, w))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = suffix_dedup.Settings(hot_classes=50, bucket_windows=4000, batch_windows=1000)
    found = suffix_dedup.measure_repeats(suffix_dedup.find_repeats(docs, s)).collect()
    assert sorted(map(tuple, found), key=str) == brute_repeats(rows)


def rows_tail(short, w):
    return short[:150] + w(60)


def test_cut_text_stays_text(spark):
    body = "é" * 150
    docs = spark.createDataFrame([(1, "x" + body), (2, body + "y"), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert out == {1: "x", 2: "y", 3: None}


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and 100 * both >= 75 * len(sets[i] | sets[k]):
                parent[find(i)] = find(k)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((x for x in members[find(i)] if x is not None), default=None)) for i in range(len(rows))), key=str)


def near_copies():
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base, rows = r.choices(words, k=120), []
    for k in range(120):
        edited = list(base)
        for _ in range(r.randint(0, 9)):
            edited[r.randrange(len(edited))] = r.choice(words)
        rows.append((k, " ".join(edited)))
    passage = " ".join(r.choices(words, k=40))
    rows += [(200 + k, " ".join(r.choices(words, k=r.randint(10, 60))) + " " + passage) for k in range(50)]
    return rows + [(300, None), (301, ""), (302, "a b"), (303, "A b"), (304, "a  b"), (305, "a b c d e"), (306, " \n"), (307, "x"), (0, "x"), (None, "x"), (310, rows[3][1]), (311, rows[3][1]), (311, rows[3][1]), (312, " ".join(words * 40))]


@pytest.mark.parametrize("settings", [ngram_join.Settings(), ngram_join.Settings(chunk_classes=16, chunk_shingles=900, frequent_from=100, leaf=4, fan_out=2), ngram_join.Settings(frequent=5), ngram_join.Settings(frequent_from=3, hot_times=3, salts=5)])
def test_components_equal_brute_force(spark, settings):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("clash")).withColumn("n", F.lit(0))
    out = ngram_join.near_duplicates(docs, settings).select("__id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, out), key=str) == brute_components(rows)


def test_components_equal_sql(spark, sf_dir):
    assert same_as_sql(spark, ngram_join.query, ngram_join.ORACLE, sf_dir) > 0


def test_bitmaps_never_prune_a_link():
    r = np.random.default_rng(2)
    st = ngram_join.Settings(leaf=3, fan_out=2)
    pool = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(r.choice(pool, int(n))) for n in r.integers(1, 200, 60)]
    sets += [np.unique(np.r_[s[: max(1, int(len(s) * 0.9))], r.integers(0, 2**63, 2).astype(np.uint64)]) for s in sets]
    found = set()
    for a, b in ngram_join.possible_pairs(np.array([len(s) for s in sets]), [ngram_join.bitmap_of(s) for s in sets], st):
        found |= {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    for i in range(len(sets)):
        for k in range(i):
            if ngram_join.linked(sets[i], sets[k], st):
                assert frozenset((i, k)) in found


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(none).count() == 0
    assert suffix_dedup.measure_repeats(suffix_dedup.find_repeats(none)).count() == 0
    assert secret_scan.scan(none).count() == 0
    assert quality_rules.judge(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_stages_one_by_one(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.stash(stages.drop_low_quality(spark, docs, sf_dir), "t")
    verdicts = {r["doc_id"] for r in quality_rules.query(spark, sf_dir).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdicts and kept.columns == docs.columns
    one = corpus_pipeline.stash(stages.drop_near_duplicates(spark, kept, sf_dir), "t")
    groups = brute_components([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c if n else d for d, n, c in groups})
    cut = corpus_pipeline.stash(stages.cut_repeats(spark, one, sf_dir), "t")
    lengths = {d: (n, removed) for d, n, removed, _, _ in brute_repeats([(r["doc_id"], r["text"]) for r in one.collect()])}
    for r in cut.collect():
        n, removed = lengths[r["doc_id"]]
        assert len(r["text"].encode()) <= n - removed and (removed or len(r["text"].encode()) == n)
        assert r["n_chars"] == len(r["text"])
    clean = corpus_pipeline.stash(stages.redact_secrets(spark, cut, sf_dir), "t")
    before = {r["doc_id"]: r["text"] for r in cut.collect()}
    for r in clean.collect():
        found = any(len(m.group(rule.group)) >= max(1, rule.least) for rule in secret_scan.RULES for m in re.finditer(rule.pattern, before[r["doc_id"]]))
        assert ("[SECRET]" in r["text"]) == found
    packed = stages.pack(spark, clean, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "suffix_dedup", "secret_scan", "packing"]


def test_stages_keep_one_of_repeated_rows(spark, sf_dir):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, long, "en", "s", 0), (1, long, "en", "s", 0), (2, long, "en", "s", 0), (3, None, "en", "s", 0), (3, None, "en", "s", 0), (None, "alone " * 3, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stages.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"] or -1, r["text"] is None) for r in out) == [(-1, False), (1, False), (3, True), (3, True)]


def test_stage_keeps_different_texts_of_null_and_shared_ids(spark, sf_dir):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(30))
    rows = [(None, text(k)) for k in range(8)] + [(None, text(0)), (None, text(1) + " more")]
    rows += [(7, text(k)) for k in range(20, 24)] + [(7, text(20)), (8, text(21)), (9, text(30)), (None, None), (None, "")]
    out = stages.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    kept = sorted((r["text"] or "").removesuffix(" more") for r in out)
    assert kept == sorted(["", "", *(text(k) for k in [*range(8), *range(20, 24), 30])])


def test_stage_tells_texts_of_one_32_bit_hash_apart(spark, sf_dir):
    from pyspark.sql import Window

    made = spark.range(150_000).select(F.concat_ws(" ", *(F.concat(F.lit(f"w{j}x"), "id") for j in range(6))).alias("text"))
    same = made.withColumn("n", F.count("*").over(Window.partitionBy(F.hash("text")))).where("n > 1").select(F.lit(None).cast("long").alias("doc_id"), "text")
    rows = same.collect()
    assert len(rows) > 1
    out = stages.drop_near_duplicates(spark, spark.createDataFrame(rows, same.schema), sf_dir)
    assert sorted(r["text"] for r in out.collect()) == sorted(r["text"] for r in rows)


def test_a_meeting_holds_a_chunk_and_a_lot(spark):
    from itertools import combinations

    hub, size = 0, 6
    state = {c: (1 + (c - 1) // size - 1, c in (1, 2) or c > 3 * size) for c in range(1, 4 * size + 1)}  # class: chunk, apart
    chunks = spark.createDataFrame([(hub, c, 4, chunk) for c, (chunk, _) in state.items()] + [(hub, hub, 4, k) for k in range(4)] + [(100, 100, 1, 0), (100, 101, 1, 0)], "hub long, class long, chunks int, chunk int")
    first = spark.createDataFrame([(hub, c, c if apart else hub, not apart) for c, (_, apart) in state.items()] + [(hub, hub, hub, True), (100, 101, 101, False)], "hub long, a long, b long, to_hub boolean")
    weights = spark.createDataFrame([(c, 10) for c in state], "class long, n long")
    groups, rows = {}, 0
    for r in ngram_join._across(chunks, first, weights, 40).collect():
        groups.setdefault((r["at"], r["lot"]), []).append(r["class"])
        rows += 1
        assert r["hub"] == hub and (r["chunk"], r["b"]) == (state[r["class"]][0], r["class"] if state[r["class"]][1] else hub)
    apart = sum(a for _, a in state.values())
    lots = len({lot for _, lot in groups})
    assert lots == 2 and rows == len(state) * lots + apart * 3
    together = {p for g in groups.values() for p in combinations(sorted(g), 2)}
    assert all(len(g) == len(set(g)) for g in groups.values())
    assert all((a, b) in together for a, b in combinations(state, 2) if state[a][0] != state[b][0] and (state[a][1] or state[b][1]))


def test_long_chains_and_stars_are_one_component(spark):
    chain = [(k, k + 1) for k in range(700)]
    star = [(5000, 5001 + k) for k in range(300)]
    r = random.Random(2)
    other = [(9000 + r.randrange(80), 9000 + r.randrange(80)) for _ in range(60)]
    rows = [(a, b) if r.random() < 0.5 else (b, a) for a, b in chain + star + other if a != b]
    got = {x["node"]: x["label"] for x in ngram_join.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {n: n for e in rows for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in rows:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    assert got == want
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_clusters_under_one_prefix_equal_brute_force(spark):
    r = random.Random(8)
    head, rows = "one two three four five", []
    for k in range(25):
        base = [f"c{k}w{j}" for j in range(30)]
        for copy in range(4):
            edited = list(base)
            edited[r.randrange(len(base))] = f"e{k}{copy}"
            rows.append((4 * k + copy, f"{head} {' '.join(edited if copy else base)}"))
    r.shuffle(rows)
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Settings(chunk_shingles=300, chunk_classes=16, frequent=0))
    assert sorted(map(tuple, found.select("__id", "n_shingles", "component_id").collect()), key=str) == brute_components(rows)


CLASHING = "__id long, __tag int, __text string, __kinds string, __doc_id long, __secrets string, __repeats string, __c_id int, o_id int, o_tag int, __s_id int, __row string, `a b` int, kept boolean, component string"


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Columns that bear the operators' own names come through every stage as they were; so does an empty table."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    names = [c.rsplit(" ", 1)[0].strip("`") for c in CLASHING.split(", ")]
    wide = docs.withColumns({c: F.concat_ws("-", F.lit(c), "doc_id") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, sf_dir), stage(spark, wide, sf_dir)
        assert got.columns == wide.columns
        assert sorted(map(tuple, got.select(*docs.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert got.where(F.exists(F.array(*(F.col(f"`{c}`") != F.concat_ws("-", F.lit(c), "doc_id") for c in names)), lambda x: x)).count() == 0
        none = stage(spark, wide.where("false"), sf_dir)
        assert none.columns == wide.columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide.where("false"), sf_dir).count() == 0
