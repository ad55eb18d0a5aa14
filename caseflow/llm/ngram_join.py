"""Exact n-gram Jaccard self-join and its connected components, with signature trees.

A text's set holds the hashes of its 5-word shingles. Equal sets are one class. Two sets with a
Jaccard similarity of ``similarity`` or more share one of the first ``n - ceil(similarity n) + 1``
shingles of each, in any fixed order of all shingles; the order puts frequent ones last. Classes that
share such a key with the smallest class that has it (the hub) form the hub's block, so every pair
that could link lies in a block.

A block is joined with itself by a signature tree: leaves of classes of similar size, nodes with the
OR of their token bitmaps and their size range. A dual traversal drops node pairs whose largest
possible overlap is too small. It runs on bitmaps first, which leaves the classes with a possible
partner, then on the sets of those, where pairs are verified exactly and pairs that are connected
already are skipped. Blocks are dealt in chunks of bounded size. Every chunk holds the hub; only what it
doesn't connect to the hub visits the other chunks of the block, in lots of bounded size. Sets and
shingles are known by 64-bit hashes: two different ones of n meet with a chance of n * n / 2 ** 65.

Defined results: null, empty and wordless text has no shingles and links with nothing; with fewer than
``words`` words the whole sequence is the only shingle; rows that repeat a doc_id are joined one by
one; a component is named by its smallest doc_id (null only if it has no other).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm._common import fanout, read, stash, steps
from caseflow.llm.suffix_dedup import Hashes, mixed


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Similarity as a fraction of integers: 75 / 100.
    at_least: int = 75
    of: int = 100
    #: Frequent shingles that are ordered last; any number gives the same result.
    frequent: int = 200_000
    frequent_from: int = 12
    #: Rows from which a frequent shingle is hot, and the parts that the rows of a hot one are dealt to.
    hot_times: int = 1 << 16
    salts: int = 256
    leaf: int = 32
    fan_out: int = 8
    #: Classes and shingles of one chunk of a block.
    chunk_classes: int = 4096
    chunk_shingles: int = 2_000_000


# ---- sets


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode().lower() for t in texts]  # bytes lower-case A-Z only
    buffer = b"\n".join([*raw, b""])
    x = np.frombuffer(buffer, np.uint8)
    inside = ~((x == 32) | ((x >= 9) & (x <= 13)))
    edge = np.diff(np.r_[0, inside.view(np.int8), 0])
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = Hashes(buffer)(start, end)
    offset = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(start, offset)
    rolled = np.zeros(len(h), np.uint64)
    for k in range(words):
        n = max(0, len(h) - k)
        rolled[:n] = mixed(rolled[:n] + np.uint64(k + 1)) + h[k:]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for w in h[a:b]:
                one = mixed(one) + w
            out.append(mixed(one + np.uint64(0x51ED270B)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of the set: from its size, sum and parity of hashes."""
    a = mixed(np.array([np.add.reduce(s) + np.uint64(len(s))], np.uint64))
    return int((mixed(a ^ mixed(np.array([np.bitwise_xor.reduce(s)], np.uint64)))).view(np.int64)[0])


def prefix_of(s: np.ndarray, frequent: np.ndarray, st: Settings) -> np.ndarray:
    """The keys of which a set that links must share one."""
    n = len(s)
    most = n + (-st.at_least * n) // st.of + 1  # n - ceil(n * similarity) + 1
    late = is_in(s, frequent)
    return np.r_[s[~late], s[late]][:most]


def is_in(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values a sorted array holds."""
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values if len(held) else np.zeros(len(values), bool)


def bitmap_of(s: np.ndarray) -> np.ndarray:
    """A bit per shingle in at least twice as many bits, a power of two, as 64-bit words."""
    bits = 1 << max(6, int(2 * len(s)).bit_length())
    place = (s >> np.uint64(20)).astype(np.int64) & (bits - 1)
    words = np.zeros(bits >> 6, np.uint64)
    np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return words


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap in fewer words; bits that fall together can only raise an overlap's bound."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), axis=0) if len(bitmap) > words else bitmap


# ---- signature trees


class SignatureTree:
    """Classes in order of size, grouped into nodes with OR-ed bitmaps and size ranges."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, bitmaps: list[np.ndarray], words: int, st: Settings):
        self.members = members[np.argsort(sizes[members], kind="stable")]
        self.size = sizes[self.members].astype(np.int64)
        self.bits = np.array([folded(bitmaps[i], words) for i in self.members])
        self.shared = self.size - np.bitwise_count(self.bits).sum(1, dtype=np.int64)  # shingles on a bit of another one's
        # levels of (first, behind last) positions, OR-ed bitmaps, largest ``shared``; the leaves come first
        self.levels = [self._level(np.arange(0, len(members), st.leaf))]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._level(self.levels[-1][0][:: st.fan_out]))

    def _level(self, first: np.ndarray):
        return first, np.r_[first[1:], len(self.members)], np.bitwise_or.reduceat(self.bits, first, axis=0), np.maximum.reduceat(self.shared, first)

    def below(self, level: int, node: int) -> range:
        first, last = self.levels[level][0][node], self.levels[level][1][node]
        return range(*np.searchsorted(self.levels[level - 1][0], (first, last)))


def least_overlap(a, b, st: Settings):
    """Shingles that linked sets of these sizes share at least."""
    return -(-st.at_least * (a + b) // (st.at_least + st.of))


def meet(x: SignatureTree, y: SignatureTree, st: Settings, settled) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of two trees (or of one, with itself) that could link, leaf pair by leaf pair.

    ``settled(members, members)`` says that a leaf pair has nothing more to tell.
    """
    todo = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while todo:
        lx, i, ly, k = todo.pop()
        (fx, tx, bx, sx), (fy, ty, by, sy) = x.levels[lx], y.levels[ly]
        low_x, high_x, low_y, high_y = x.size[fx[i]], x.size[tx[i] - 1], y.size[fy[k]], y.size[ty[k] - 1]
        if high_x * st.of < low_y * st.at_least or high_y * st.of < low_x * st.at_least:
            continue
        most = min(high_x, high_y, int(np.bitwise_count(bx[i] & by[k]).sum()) + min(sx[i], sy[k]))
        if most < least_overlap(low_x, low_y, st):
            continue
        if lx or ly:  # down the higher one, both of one tree at once
            if x is y:
                todo += [(lx - 1, p, ly - 1, q) for p in x.below(lx, i) for q in y.below(ly, k) if i != k or p <= q]
            elif lx >= ly:
                todo += [(lx - 1, p, ly, k) for p in x.below(lx, i)]
            else:
                todo += [(lx, i, ly - 1, q) for q in y.below(ly, k)]
            continue
        a, b = np.arange(fx[i], tx[i]), np.arange(fy[k], ty[k])
        if settled(x.members[a], y.members[b]):
            continue
        overlap = np.bitwise_count(x.bits[a][:, None, :] & y.bits[b][None, :, :]).sum(2, dtype=np.int64)
        overlap += np.minimum(x.shared[a][:, None], y.shared[b][None, :])
        ok = np.minimum(overlap, np.minimum(x.size[a][:, None], y.size[b][None, :])) >= least_overlap(x.size[a][:, None], y.size[b][None, :], st)
        if x is y and i == k:
            ok = np.triu(ok, 1)
        p, q = np.nonzero(ok)
        if len(p):
            yield x.members[a[p]], y.members[b[q]]


def possible_pairs(sizes: np.ndarray, bitmaps: list[np.ndarray], st: Settings, settled=lambda a, b: False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs that the bitmaps allow: a tree for each bitmap length, joined with itself and the next length's."""
    words = np.array([len(b) for b in bitmaps])
    for w in np.unique(words).tolist():
        here = SignatureTree(np.flatnonzero(words == w), sizes, bitmaps, w, st)
        yield from meet(here, here, st, settled)
        longer = np.flatnonzero(words == 2 * w)  # sets that could link differ by less than a factor of two
        if len(longer):
            yield from meet(here, SignatureTree(longer, sizes, bitmaps, w, st), st, settled)


def possible_partners(sizes: np.ndarray, bitmaps: list[np.ndarray], st: Settings) -> np.ndarray:
    """Which classes have a partner that the bitmaps allow."""
    hit = np.zeros(len(sizes), bool)
    if len(sizes) > 1:
        for a, b in possible_pairs(sizes, bitmaps, st, lambda a, b: hit[a].all() and hit[b].all()):
            hit[a] = True
            hit[b] = True
    return hit


def linked(a: np.ndarray, b: np.ndarray, st: Settings) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both > 0 and st.of * both >= st.at_least * (len(a) + len(b) - both)


def connect(sets: list[np.ndarray], st: Settings, hub: int | None = None, known: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """The smallest position connected to each set, by exactly verified links; connected pairs aren't looked at again.

    ``known`` holds the positions that are connected already; only sets of different ``side`` are compared.
    """
    label = np.arange(len(sets)) if known is None else known.copy()
    side = np.arange(len(sets)) if side is None else side

    def join(i: int, k: int) -> None:
        x, y = sorted((label[i], label[k]))
        if x != y and linked(sets[i], sets[k], st):
            label[label == y] = x

    if hub is not None:
        for k in range(len(sets)):
            join(hub, k)
    if (label != label[0]).any():
        settled = lambda a, b: any((x[a] == x[a[0]]).all() and (x[b] == x[a[0]]).all() for x in (label, side))
        for a, b in possible_pairs(np.array([len(s) for s in sets]), [bitmap_of(s) for s in sets], st, settled):
            for n in np.flatnonzero((label[a] != label[b]) & (side[a] != side[b])).tolist():
                join(int(a[n]), int(b[n]))
    return label


# ---- the jobs


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("__id"), F.xxhash64(text).alias("__tag"), F.col(text).alias("__text"))


def sets_and_frequent(keyed: DataFrame, st: Settings, task_shingles: int = 1 << 21) -> DataFrame:
    """Rows (__id, __tag, n, class) for texts, and rows (shingle, times) for shingles that a task meets three times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = ["__id", "__tag", "n", "class", "shingle", "times"]

        def often():
            value, times = np.unique(np.concatenate(held), return_counts=True)
            value, times = value[times > 2].view(np.int64), times[times > 2]
            none = pa.nulls(len(value), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(value), pa.array(times.astype(np.int64))], names)

        for whole in batches:
            for b in steps(whole, "__text"):
                sets = shingle_sets(b.column("__text").to_pylist(), st.words)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), none, none], names)
                held += sets
                size += sum(map(len, sets))
                if size >= task_shingles:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    return keyed.mapInArrow(run, "__id long, __tag long, n long, class long, shingle long, times long")


def _most_frequent(often: DataFrame, st: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the highest powers of two of ``times`` that together are ``st.frequent`` at most, and the hot ones; sorted."""
    power = F.floor(F.log2("times")).cast("int")
    held, least = 0, 64
    for r in sorted(often.groupBy(power.alias("power")).count().collect(), key=lambda r: -r["power"]):  # 64 rows at most
        held += r["count"]
        if held > st.frequent:
            break
        least = r["power"]
    found = often.where(power >= least).select("shingle", "times").toPandas()
    shingle = found["shingle"].to_numpy(np.int64).view(np.uint64)
    return np.sort(shingle), np.sort(shingle[found["times"].to_numpy() >= st.hot_times])


def prefixes(keyed: DataFrame, frequent: np.ndarray, hot: np.ndarray, st: Settings, remember: int = 1 << 19) -> DataFrame:
    """(key, class) for the prefix of every set; a task gives equal sets once. Where there are hot keys, also a salt: 1 or more, by class, for these."""
    shared = keyed.sparkSession.sparkContext.broadcast((frequent, hot))  # at most ``frequent`` numbers each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        late, salted = shared.value
        for whole in batches:
            for b in steps(whole, "__text"):
                keys, names = [], []
                for s in shingle_sets(b.column("__text").to_pylist(), st.words):
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        keys.append(prefix_of(s, late, st))
                        names.append(c)
                if len(seen) > remember:
                    seen = set()
                if keys:
                    key, name = np.concatenate(keys), np.repeat(np.array(names, np.int64), [len(k) for k in keys])
                    columns = {"key": pa.array(key.view(np.int64)), "class": pa.array(name)}
                    if len(salted):
                        columns["salt"] = pa.array(np.where(is_in(key, salted), 1 + name % st.salts, 0).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return keyed.mapInArrow(run, "key long, class long" + (", salt int" if len(hot) else ""))


def hub_edges(keyed: DataFrame, often: DataFrame, st: Settings) -> DataFrame:
    """(hub, class): what shares a prefix shingle with the smallest class that has it."""
    frequent, hot = _most_frequent(often, st)
    by_key = Window.partitionBy("key", *(["salt"] if len(hot) else []))
    keys = prefixes(keyed, frequent, hot, st).withColumn("hub", F.min("class").over(by_key)).withColumn("last", F.max("class").over(by_key))
    apart = "hub < last and class <> hub"
    if not len(hot):
        return keys.where(apart).select("hub", "class").distinct()
    # hot keys are dealt by class as well; their hubs come from minima that combine before the exchange
    keys = stash(keys.where(f"salt > 0 or ({apart})").select(F.expr("CASE WHEN salt > 0 THEN key END").alias("key"), F.expr("CASE WHEN salt = 0 THEN hub END").alias("hub"), "class"), "keys")
    rows = keys.where("hub is null").select("key", "class")
    hubs = stash(rows.groupBy("key").agg(F.min("class").alias("hub"), F.max("class").alias("last")).where("hub < last").select("key", "hub"), "hubs")
    return keys.where("hub is not null").select("hub", "class").unionByName(rows.join(hubs, "key").where("class <> hub").select("hub", "class")).distinct()


def _class_texts(keyed: DataFrame, reps: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, __text) for the given classes, from one row each; rows that are repeated whole give it again."""
    reps = reps.join(classes, "class").select("class", F.col("r.__id").alias("r_id"), F.col("r.__tag").alias("r_tag"))
    return keyed.join(reps, keyed["__id"].eqNullSafe(reps["r_id"]) & (keyed["__tag"] == reps["r_tag"])).select("class", "__text")


def _sets(texts: DataFrame, st: Settings, column: str, value) -> DataFrame:
    """(class, n, ``column``): the set of each text, as ``value`` writes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in steps(whole, "__text"):
                sets = shingle_sets(b.column("__text").to_pylist(), st.words)
                yield pa.RecordBatch.from_arrays([b.column("class"), pa.array([len(s) for s in sets], pa.int64()), pa.array([value(s).tobytes() for s in sets], pa.binary())], ["class", "n", column])

    return texts.mapInArrow(run, f"class long, n long, {column} binary")


def _dealt(members: DataFrame, weight: str, most: int) -> DataFrame:
    """(hub, class, chunks, chunk): members of each hub dealt to chunks of about ``most`` weight, the hub in all of its block's."""
    size = members.groupBy("hub").agg(F.ceil(F.sum(weight) / most).cast("int").alias("chunks"))
    rows = members.join(size, "hub")
    own = F.array(F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    return rows.withColumn("chunk", F.explode(F.when(F.col("class") == F.col("hub"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own))).select("hub", "class", "chunks", "chunk")


def _run_blocks(members: DataFrame, keys: list[str], work, schema: str, parts: int, alone: str = "false") -> DataFrame:
    """``work(pdf)`` per block; many small blocks are held at once, of those that are ``alone`` one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done = [work(block.drop_duplicates("class")) for _, block in pdf.groupby(keys, sort=False)]
        return pd.concat(done) if done else pd.DataFrame()

    return members.groupBy(F.when(F.expr(alone), F.xxhash64(*keys)).otherwise(F.pmod(F.xxhash64(*keys), F.lit(parts))).alias("__part")).applyInPandas(run, schema)


def _across(chunks: DataFrame, first: DataFrame, weights: DataFrame, most: int) -> DataFrame:
    """(hub, class, b, chunk, at, lot): where classes of blocks in several chunks meet those of other chunks.

    What its own chunk doesn't connect to the hub visits all other chunks, in lots of about ``most`` weight; the rest
    stays at home. A group is one chunk and one lot, so it is bounded, and what is connected to the hub is given out once
    a lot.
    """
    several = chunks.where("chunks > 1 and class <> hub")
    state = several.join(first.select("hub", F.col("a").alias("class"), "b", "to_hub"), ["hub", "class"])
    apart = state.where("not to_hub").join(weights, "class")
    lots = apart.groupBy("hub").agg(F.ceil(F.sum("n") / most).cast("int").alias("lots"))
    visits = apart.join(lots, "hub").withColumn("lot", F.pmod(F.xxhash64("class", F.lit(7)), F.col("lots")).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    homes = state.join(lots, "hub").withColumn("at", F.col("chunk")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    columns = ["hub", "class", "b", "chunk", "at", "lot"]
    return homes.select(*columns).unionByName(visits.where("at <> chunk").select(*columns))


def links(docs: DataFrame, st: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): __id, __tag, n and class of each text; (a, b) pairs of classes whose components are those of all links."""
    keyed, parts = _keyed(docs, doc_id, text), 4 * max(fanout(docs), 1)
    seen = stash(sets_and_frequent(keyed, st), "sets")
    rows = seen.where("shingle is null").select("__id", "__tag", "n", "class")
    # one row of each class, combined before the exchange: a class may hold a third of all rows
    reps = stash(rows.where("n > 0").groupBy("class").agg(F.min(F.struct("__id", "__tag")).alias("r"), F.first("n").alias("n")), "classes")
    often = seen.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= st.frequent_from)
    edges = stash(hub_edges(keyed, often, st), "edges")
    members = edges.unionByName(edges.select("hub", F.col("hub").alias("class")).distinct())

    # on bitmaps: who has a possible partner in its block; blocks of more than a chunk keep all, as each class would meet all chunks
    def partners(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = possible_partners(pdf["n"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["bits"]], st)
        return pdf.loc[hit, ["hub", "class"]]

    size = stash(members.groupBy("hub").agg((F.count("*") > st.chunk_classes).alias("large")), "blocks")
    members = members.join(size, "hub")
    one_chunk = members.where("not large").select("hub", "class")
    bits = _sets(_class_texts(keyed, reps, one_chunk.select("class").distinct()), st, "bits", bitmap_of)
    kept = _run_blocks(one_chunk.join(bits, "class"), ["hub"], partners, "hub long, class long", parts)
    kept = kept.unionByName(kept.select("hub", F.col("hub").alias("class"))).unionByName(members.where("large").select("hub", "class"))
    kept = stash(kept.distinct(), "kept")

    # on sets: verified links; each class gets the smallest class it is connected to within its chunk
    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class")
        names, hub = pdf["class"].to_numpy(), pdf["hub"].iloc[0]
        at = np.flatnonzero(names == hub)
        root = connect([np.frombuffer(x, np.uint64) for x in pdf["items"]], st, int(at[0]) if len(at) else None)
        to_hub = root == root[at[0]] if len(at) else np.zeros(len(root), bool)
        return pd.DataFrame({"hub": pdf["hub"].to_numpy(), "a": names, "b": names[root], "to_hub": to_hub})

    def met_across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class")
        names = pdf["class"].to_numpy()
        _, at, which = np.unique(pdf["b"].to_numpy(), return_index=True, return_inverse=True)
        known = at[which]  # as the chunks found it
        root = connect([np.frombuffer(x, np.uint64) for x in pdf["items"]], st, None, known, pdf["chunk"].to_numpy())
        new = root != known
        return pd.DataFrame({"a": names[new], "b": names[root[new]]})

    found = "hub long, a long, b long, to_hub boolean"
    sizes = reps.select("class", "n")
    chunks = stash(_dealt(kept.join(sizes, "class"), "n", st.chunk_shingles), "chunks")
    items = stash(_sets(_class_texts(keyed, reps, kept.select("class").distinct()), st, "items", lambda s: s), "items").select("class", "items")
    first = stash(_run_blocks(chunks.join(items, "class"), ["hub", "chunk"], joined, found, parts, "chunks > 1"), "links")
    pairs = first.select("a", "b")
    if first.where("not to_hub").join(chunks.where("chunks > 1").select("hub", F.col("class").alias("a")), ["hub", "a"], "left_semi").limit(1).count():
        met = _across(chunks, first, sizes, st.chunk_shingles).join(items, "class")
        pairs = pairs.unionByName(_run_blocks(met, ["hub", "at", "lot"], met_across, "a long, b long", parts, "true"))
    return rows, pairs.where("a <> b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node connected to each node that has a pair.

    Large-star and small-star in turn, until the edges stay as they are: every node's larger neighbours, then all of
    them, are tied to its smallest one. The edges then join each node to the smallest of its component; the number of
    rounds grows with the square of the logarithm of the nodes at most. A node with very many neighbours is only ever
    aggregated to its smallest one, combined before the exchange, and met by a plain join, which Spark can split.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Edges (a, b), a > b: ties every node's neighbours that are larger (or not) than it to the smallest of all."""
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = around.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("n"), F.least("a", "b").alias("m"))
        met = around.join(least, F.col("a") == F.col("n"))
        if large:
            return met.where("b > n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return met.select("b", "m").unionByName(least.select(F.col("n").alias("b"), "m")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    edges = stash(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "graph")
    state = None
    while True:
        edges = stash(star(stash(star(edges, True), "graph"), False), "graph")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(docs: DataFrame, st: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """__id, __tag, n_shingles, component_id and component of every row of ``docs``.

    ``component_id`` is null for components of null ids, and shared by components that share an id; ``component`` is their
    own (null without shingles).
    """
    rows, pairs = links(docs, st, doc_id, text)
    labels = components(pairs)
    # one row per class first: a class may hold a third of all rows
    named = rows.where("n > 0").groupBy("class").agg(F.min("__id").alias("least")).join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    # as a plain table, so that Spark can split the partition of a class that holds many rows
    named = stash(named.join(least, "label").select("class", "component", "label"), "named")
    out = rows.join(named, "class", "left")
    return out.select("__id", "__tag", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("__id")).alias("component_id"), F.when(F.col("n") > 0, F.col("label")).alias("component"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: near-duplicate components of all documents."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || '|' || len(ws)] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM sh),
e AS (SELECT doc_id, unnest(s) AS g FROM sh),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT r.d, l.b FROM r JOIN l ON r.c = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY 1, 2
"""
