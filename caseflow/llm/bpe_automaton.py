"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, one after the other, into a deterministic automaton over tokens. It starts
with one state whose loops are the base symbols. The gadget of merge ``u v -> w`` takes the arc ``v``
away from the state that ``u`` leads to (splitting that state off first if other tokens lead there
too) and lets ``w`` lead where ``v`` led; every state that had an arc ``u`` before ``v`` gets ``w``.
Accepted paths are then exactly the token sequences that the merges produce, and each text has one.

Arcs are stored by what is missing. A token that begins with ``v`` and was made after ``v`` lost its
arc is missing as well, and tokens are numbered so that these form one interval: depth first through
"begins with", the latest first. A state is a short list of missing intervals in one sorted table.

Encoding walks all words of a batch in step: at each end position it takes the token that ends there
and has an arc from the state of the path so far. Decoding emits the labels of the arcs.

Defined results: null text is empty and has no tokens; special tokens of the file are found in the
raw text and emitted as they are; rows with equal ids are encoded one by one.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseflow.llm._common import read, steps

#: Bits for a token's number within a key.
BITS = 20
#: Symbols up to which words walk in step with others.
IN_STEP = 512
#: Words that a task remembers; beyond that it starts afresh, so memory is bounded.
REMEMBER = 150_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """The compiled merges. ``words`` are given as symbols: a byte, plus 256 on a word's last byte."""

    def __init__(self, merges: list[tuple[int, int, int]], spelled: dict[int, tuple[int, ...]], size: int):
        """merges: (left, right, made) in order; spelled: token -> symbols, base symbols of length 1."""
        state_of, lacks, users, states = [0] * size, [[]], [size + 1], 1
        for rank, (u, v, w) in enumerate(merges):
            state_of[w] = state_of[v]
            s = state_of[u]
            if users[s] > 1 or u == v:  # size+1 users keep the start state as it is
                users[s] -= 1
                lacks.append(lacks[s].copy())
                users.append(1)
                state_of[u] = s = states
                states += 1
            lacks[s].append((v << BITS) | rank)
            users[state_of[w]] += 1
        self.state_of = np.array(state_of, np.int64)
        self._number(merges, size)
        self._intervals(lacks)
        self._trie(spelled)

    def _number(self, merges, size: int) -> None:
        """Preorder numbers of "begins with", children from the latest to the first; end: behind the last descendant."""
        below: list[list[int]] = [[] for _ in range(size)]
        self.rank = np.full(size, -1, np.int64)
        for rank, (u, _, w) in enumerate(merges):
            below[u].append(w)
            self.rank[w] = rank
        self.number, self.end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = 0
        for root in np.flatnonzero(self.rank < 0).tolist():
            todo = [(root, False)]
            while todo:
                t, done = todo.pop()
                if done:
                    self.end[t] = at
                    continue
                self.number[t] = at
                at += 1
                todo.append((t, True))
                todo += [(c, False) for c in below[t]]  # the last pushed, the latest made, comes first
        children = [(u << BITS) | ((1 << BITS) - 1 - rank) for rank, (u, _, w) in enumerate(merges)]
        order = np.argsort(children)
        self._child_key = np.array(children, np.int64)[order]
        self._child_end = self.end[np.array([w for _, _, w in merges], np.int64)[order]] if merges else np.zeros(0, np.int64)

    def _intervals(self, lacks: list[list[int]]) -> None:
        owner = np.repeat(np.arange(len(lacks)), [len(x) for x in lacks])
        packed = np.array([p for x in lacks for p in x], np.int64)
        token, rank = packed >> BITS, packed & ((1 << BITS) - 1)
        # behind v's children of this rank or later, which directly follow v
        k = np.searchsorted(self._child_key, (token << BITS) | ((1 << BITS) - 1 - rank), "right") - 1
        own = (k >= 0) & (self._child_key[np.maximum(k, 0)] >> BITS == token) if len(self._child_key) else np.zeros(len(token), bool)
        end = np.where(own, self._child_end[np.maximum(k, 0)] if len(self._child_end) else 0, self.number[token] + 1)
        low, high = (owner << BITS) + self.number[token], (owner << BITS) + end
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order]) if len(order) else high
        first = np.r_[True, low[1:] > high[:-1]] if len(low) else np.zeros(0, bool)
        self.low, self.high = low[first], high[np.r_[np.flatnonzero(first)[1:] - 1, len(high) - 1]] if len(low) else high

    def _trie(self, spelled: dict[int, tuple[int, ...]]) -> None:
        child: dict[int, int] = {}
        token = [-1]
        for t, symbols in spelled.items():
            node = 0
            for s in symbols:
                key = (node << 9) | s
                if key not in child:
                    child[key] = len(token)
                    token.append(-1)
                node = child[key]
            token[node] = t
        keys = np.array(list(child), np.int64)
        order = np.argsort(keys)
        self.trie_key, self.trie_node = keys[order], np.array(list(child.values()), np.int64)[order]
        self.trie_token = np.array(token, np.int64)
        self.span = np.zeros(len(self.state_of), np.int64)
        self.span[list(spelled)] = [len(symbols) for symbols in spelled.values()]
        self.longest = int(self.span.max())

    def _has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = (state << BITS) + self.number[token]
        k = np.searchsorted(self.low, key, "right") - 1
        return (k < 0) | (self.high[np.maximum(k, 0)] <= key)

    def _walk(self, found: list[np.ndarray], last: np.ndarray) -> None:
        """The path of one word, over its tokens by where they end."""
        starts = [np.flatnonzero(row >= 0) for row in found]
        end = np.concatenate([s + k for k, s in enumerate(starts)])  # the last symbol of each token
        size = np.repeat(np.arange(1, len(found) + 1), [len(s) for s in starts])
        token = np.concatenate([row[s] for row, s in zip(found, starts)])
        order = np.argsort(end, kind="stable")
        end, size, token = end[order], size[order], token[order]
        numbers = self.number[token].tolist()
        path = [-1] * len(last)
        for e, n, t, number in zip(end.tolist(), size.tolist(), token.tolist(), numbers):
            if path[e] < 0:
                key = number if e < n else (int(self.state_of[path[e - n]]) << BITS) + number
                k = int(np.searchsorted(self.low, key, "right")) - 1
                if k < 0 or self.high[k] <= key:
                    path[e] = t
        last[:] = path

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word as little-endian unsigned 32-bit integers, all words in step."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        length = length[order]
        symbols = np.frombuffer(b"".join([words[i] for i in order]), np.uint8).astype(np.int64)
        start = np.cumsum(length) - length
        symbols[(start + length - 1)[length > 0]] += 256
        room = np.repeat(start + length, length) - np.arange(len(symbols))  # symbols from here to the word's end
        # found[L][p]: the token that spans L symbols from p on, or -1
        found, alive, node = [None], np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        for L in range(1, self.longest + 1):
            keep = room[alive] >= L
            alive, node = alive[keep], node[keep]
            key = (node << 9) | symbols[alive + L - 1]
            k = np.minimum(np.searchsorted(self.trie_key, key), len(self.trie_key) - 1)
            hit = self.trie_key[k] == key
            alive, node = alive[hit], self.trie_node[k[hit]]
            if not len(alive):
                break
            row = np.full(len(symbols), -1, np.int32)
            row[alive] = self.trie_token[node]
            found.append(row)
        last = np.full(len(symbols), -1, np.int32)  # the token that ends with this symbol on the path
        alone = int(np.searchsorted(-length, -IN_STEP, "left"))  # longer words walk one by one
        for a, n in zip(start[:alone].tolist(), length[:alone].tolist()):
            self._walk([row[a : a + n] for row in found[1:]], last[a : a + n])
        for i in range(1, int(length[alone]) + 1 if len(length) > alone else 0):
            todo = start[alone : np.searchsorted(-length, -i, "right")] + i  # words with at least i symbols
            for L in range(min(i, len(found) - 1), 0, -1):
                token = found[L][todo - L]
                some = np.flatnonzero(token >= 0)
                if not len(some):
                    continue
                at, token = todo[some], token[some]
                state = self.state_of[last[at - L - 1]] if i > L else np.zeros(len(at), np.int64)
                ok = self._has_arc(state, token)
                last[at[ok] - 1] = token[ok]
                if ok.any():
                    left = np.ones(len(todo), bool)
                    left[some[ok]] = False
                    todo = todo[left]
        # back along the path, last token first
        at, low, ends, tokens = (start + length)[length > 0], start[length > 0], [], []
        while len(at):
            token = last[at - 1]
            ends.append(at), tokens.append(token)
            at = at - self.span[token]
            at, low = at[at > low], low[at > low]
        result = [b""] * len(words)
        if ends:
            place = np.concatenate(ends)
            o = np.argsort(place, kind="stable")  # ends rise with the word and within it
            flat = np.concatenate(tokens)[o].astype("<u4").tobytes()
            cuts = (4 * np.searchsorted(place[o], np.r_[start, len(symbols)], "right")).tolist()
            for k, i in enumerate(order.tolist()):
                result[i] = flat[cuts[k] : cuts[k + 1]]
        return result


class WordTokenizer:
    """A tokenizers file with word ends: its normalizer and split pattern, then the automaton per word.

    Texts are split by Python's tables where these agree with the library's on every character, else by the library's
    own objects. The model is the automaton in either case.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab, letters = model["vocab"], byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.labels = [""] * size
        for label, t in [*vocab.items(), *self.specials.items()]:
            self.labels[t] = label

        def symbols(label: str) -> tuple[int, ...]:
            core = label.removesuffix(self.end) if len(label) > len(self.end) else label
            coded = [letters[c] for c in core]
            return (*coded[:-1], coded[-1] + 256 * (core != label))

        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        reached = {w for *_, w in merges}
        spelled = {t: symbols(label) for label, t in vocab.items() if label not in self.specials}
        spelled = {t: s for t, s in spelled.items() if len(s) == 1 or t in reached}
        self.automaton = Automaton(merges, spelled, size)
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer, self.letters = whole.normalizer, whole.pre_tokenizer, letters
        self.same, self.apart = set(), set()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def _usual(self, text: str) -> list[str]:
        """The split by Python's tables."""
        return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())  # letter by letter, there is no final sigma

    def _library(self, text: str) -> list[str]:
        """The split by the library's own normalizer and pre-tokenizer: exact for all characters, at several times the cost."""
        words = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.letters.__getitem__, w)).decode() for w, _ in words]

    def _agree(self, char: str) -> bool:
        """Whether both know the character alike: its class, its lower case, and its order among combining marks.

        Their tables are of different Unicode versions; characters that both have are alike for good.
        """
        probes = (f"a{char}{char}b", f"a\u0345{char}b")
        return all(self.normalizer.normalize_str(p) == unicodedata.normalize("NFC", " ".join(p.split()) if char.isspace() else p).replace("Σ", "σ").lower() and self._library(p) == self._usual(p) for p in probes)

    def pre_split(self, text: str) -> list[str]:
        """Words of the text, and special tokens as they are (each stands for itself in ``known``)."""
        out: list[str] = []
        parts = self.cut.split(text) if self.cut and any(map(text.__contains__, self.specials)) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
                continue
            new = set(part) - self.same
            for c in new - self.apart:
                (self.same if self._agree(c) else self.apart).add(c)
            out += self._library(part) if new & self.apart else self._usual(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pre_split(t) for t in texts]  # characters are looked up once a task
        if len(self.known) > REMEMBER:
            self.known = {}
        for label, t in self.specials.items():
            self.known[label] = np.array([t], "<u4").tobytes()
        new = list({w for words in split for w in words if w not in self.known})
        for w, ids in zip(new, self.automaton.encode([w.encode() for w in new])):
            self.known[w] = ids
        take = self.known.__getitem__
        return [b"".join(map(take, words)) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The arcs' labels, parted by blanks: the file names no decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256 and, on request, the ids and the decoded text."""
    spark = docs.sparkSession
    tokenizer = spark.sparkContext.broadcast(WordTokenizer(path))  # as large as the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer.value
        for whole in batches:
            for b in steps(whole, "__text"):
                coded = tok.encode_batch([t or "" for t in b.column("__text").to_pylist()])
                lists = [np.frombuffer(c, "<u4").tolist() for c in coded]
                decoded = [tok.decode(ids) for ids in lists]
                columns = [
                    *(b.column(k) for k in keep),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(lists, pa.list_(pa.int64())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    src = docs.select(*keep, F.col(text).alias("__text"))
    ddl = ", ".join([*(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    return src.mapInArrow(run, ddl + (", ids array<long>, decoded string" if with_ids else ""))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: tokens of every document, encoded and decoded."""
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
