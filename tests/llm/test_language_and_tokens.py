"""Language spans against brute-force paths; tokens against the tokenizers library."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import bpe_automaton, language_id


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return language_id.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_held_out_accuracy(spark, sf_dir):
    out = language_id.query(spark, sf_dir)
    met = out.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").where("held_out")
    right, n = met.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert right / n >= 0.97


def test_viterbi_is_the_best_path(model):
    texts = ["the of les des und der", "de la que the and", "die der und the", "les aux pour dans of the and that with"]
    for text in texts:
        g, best = model.label([text])
        s = model.word_scores(g)

        def total(path):
            return sum(s[i, k] for i, k in enumerate(path)) - model.penalty * sum(a != b for a, b in zip(path, path[1:]))

        top = max(total(p) for p in itertools.product(range(s.shape[1]), repeat=len(s)))
        assert total(best.tolist()) == pytest.approx(top)


def test_mixed_text_gives_spans(spark, model):
    text = "the of and this thing that with. " * 3 + "les aux pour avec mentou que dans le ouaux. " * 3
    rows = [(1, text), (2, None), (3, ""), (4, "12 !?"), (5, "привет"), (1, text)]
    out = language_id.label_spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [s["lang"] for s in out[0]["spans"]] == ["en", "fr"] and out[0] == out[5]
    assert [r["lang_pred"] for r in out[1:4]] == ["und"] * 3 and out[4]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in out)


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    m = language_id.fit(none)
    assert language_id.label_spans(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), m).first()["lang_pred"] == "und"


@pytest.fixture(scope="module")
def words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path), bpe_automaton.WordTokenizer(path), path


def test_tokens_equal_the_library(words):
    theirs, ours, _ = words
    rnd = random.Random(3)
    letters = [*"aeiouthsnrlüéñ'!!..aaaa  \n\t123ΣσİıéÅ🙂中文привет-_#%&", "<|endoftext|>", "<|startoftext|>", "'s", "the", "́", "ẞ"]
    vocabulary = list(theirs.get_vocab())
    texts = ["", " ", *("".join(rnd.choices(letters, k=rnd.randint(0, 50))) for _ in range(400)), *(" ".join(rnd.choices(vocabulary, k=4)) for _ in range(400))]
    for text, raw in zip(texts, ours.encode_batch(texts)):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == theirs.encode(text, add_special_tokens=False).ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_characters_of_other_unicode_versions(words):
    library, ours, _ = words
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x600 or c % 23 == 0 or 0xA7C0 <= c < 0xA800 or 0x10900 <= c < 0x10A00)]
    rng = random.Random(7)
    texts = ["a\u208fb", *(f"a{c}b" for c in chars)] + ["".join(rng.choices(chars, k=20)) for _ in range(2000)]
    texts += ["".join(rng.choice(["'s", "'LL", "Σ", "ς", "İ", "<|endoftext|>", "<|startoftext|>", " ", "\n", "a", "é", "e\u0301", "\u0345\u0301", "½", "-", "\u088f"]) for _ in range(30)) for _ in range(500)]
    for got, want in zip(ours.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids
    assert "\u208f" in ours.apart and "é" in ours.same


def test_empty_tables(spark, words, model):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_automaton.encode_documents(none, words[2]).count() == 0
    assert language_id.label_spans(none, model).count() == 0


def test_very_long_text_and_clashing_columns(spark, model, words):
    text = "the of and this thing that with. " * 40_000
    docs = spark.createDataFrame([(1, text, "x", "y")], "doc_id long, text string, lang_pred string, n_tokens string")
    assert language_id.label_spans(docs, model).first()["lang_pred"] == "en"
    coded = bpe_automaton.encode_documents(docs, words[2]).first()
    assert coded["n_tokens"] == len(words[0].encode(text, add_special_tokens=False).ids)


def test_automaton_of_a_few_merges_equals_merging():
    """All words over two letters, against merging by rank, also where a token doubles itself."""
    merges = [(0, 0, 2), (0, 1, 3), (2, 2, 4), (3, 0, 5), (1, 1, 6), (6, 1, 7), (2, 3, 8)]
    spelled = {0: (0,), 1: (1,)}
    for u, v, w in merges:
        spelled[w] = spelled[u] + spelled[v]
    a = bpe_automaton.Automaton(merges, spelled | {9: (256,), 10: (257,)}, 11)
    for n in range(1, 9):
        for word in itertools.product((0, 1), repeat=n):
            tokens = [*word[:-1], {0: 9, 1: 10}[word[-1]]]
            for u, v, w in merges:
                k = 0
                while k < len(tokens) - 1:
                    if (tokens[k], tokens[k + 1]) == (u, v):
                        tokens[k : k + 2] = [w]
                    k += 1
            assert np.frombuffer(a.encode([bytes(word)])[0], "<u4").tolist() == tokens


def test_documents_and_edge_rows(spark, words):
    theirs, _, path = words
    rows = [(1, None, "x"), (2, "", "x"), (3, "A <|endoftext|> b", "x"), (3, "A <|endoftext|> b", "y"), (None, "word " * 5000, "z"), (4, "thelonging" * 300 + " aa", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe_automaton.encode_documents(docs, path, with_ids=True).collect()
    assert len(out) == 6
    for r, (_, text, _) in zip(out, rows):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
