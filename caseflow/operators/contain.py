"""Which of many patterns stand in which texts: a join by rare keys instead of every pattern with every text.

A pattern is keyed by one of its inner words, those between two blanks: a text that holds the pattern has them as words. Where
it has none, or none rare enough, it is keyed by one of its q-grams (patterns shorter than ``q`` by themselves). Of several
keys that is taken which is rarest in the texts. A text is exploded to its distinct words, and to its distinct q-grams only if
some pattern needs them; those that key a pattern are joined, and ``contains`` decides. Rarity is measured on a fixed share of
the texts: it steers the cost, never the result.

Few patterns are broadcast and decided where the text is read. With many, a bitmap of ``BITS`` bits (2 MB, whatever the
number of patterns) drops most of the texts' keys before they are exchanged, and a text then meets its candidates once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.sources.shared import work_path

BITS = 1 << 24
#: One text in so many is looked at to tell rare q-grams from frequent ones.
SHARE = 16
#: So many candidates a text, on the average, may words bring; patterns whose words are more frequent are keyed by q-grams.
PER_TEXT = 32


def grams(body: Column, q: int) -> Column:
    """All q-grams in order, each read once: a look-ahead matches at every place."""
    return F.regexp_extract_all(body, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def words(body: Column) -> Column:
    return F.split(body, " ")


def _sampled(texts: DataFrame, share: int) -> DataFrame:
    """By key alone, so that no other body need be made."""
    return texts.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0)


def _keys(body: Column, by_words: bool, sizes: list[int]) -> Column:
    return F.array_distinct(F.concat(*([words(body)] if by_words else []), *(grams(body, q) for q in sizes)))


def _kept(index: DataFrame) -> DataFrame:
    """A work table: what it took to choose the keys is done once."""
    spark, path = index.sparkSession, work_path(index.sparkSession, "keys")
    index.write.parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def _rarest(own: DataFrame, seen: DataFrame) -> DataFrame:
    """(pattern, gram, times): of each pattern's keys ``g`` the rarest by ``seen`` (gram, times)."""
    times = own.select(F.col("g").alias("gram")).distinct().join(seen, "gram", "left").select(F.col("gram").alias("g"), F.coalesce("times", F.lit(0)).alias("times"))
    return own.join(times, "g").groupBy("pattern").agg(F.min_by("g", F.struct("times", "g")).alias("gram"), F.min("times").alias("times"))


def _often(keyed: DataFrame, most: int) -> int:
    """How often a key may have been seen for those as rare to bring ``most`` candidates at most, to a power of two; -1 if none may."""
    often = -1
    for r in keyed.groupBy(F.length(F.bin("times")).alias("power")).agg(F.max("times").alias("top"), F.sum("times").alias("n")).orderBy("power").collect():
        most -= r["n"]
        if most < 0:
            break
        often = r["top"]
    return often


def _times(texts: DataFrame, by_words: bool, sizes: list[int]) -> DataFrame:
    return texts.select(F.explode(_keys(F.col("body"), by_words, sizes)).alias("gram")).groupBy("gram").agg(F.count("*").alias("times"))


def index_of(texts: DataFrame, patterns: DataFrame, q: int, share: int = SHARE, per_text: int = PER_TEXT) -> tuple[DataFrame, bool, list[int]]:
    """(pattern, gram), a row for each pattern; whether words are among the grams, and the sizes of q-grams that are (q at most)."""
    patterns, some = patterns.select("pattern").distinct(), _sampled(texts, share)
    inner = F.array_distinct(F.filter(F.slice(words(F.col("pattern")), F.lit(2), F.greatest(F.size(words(F.col("pattern"))) - 2, F.lit(0))), lambda w: w != ""))
    own = patterns.withColumn("g", F.explode(inner))
    kept = None
    if not own.isEmpty():
        keyed = _kept(_rarest(own, _times(some, True, [])))
        if (often := _often(keyed, per_text * some.count())) >= 0:
            kept = keyed.where(F.col("times") <= often).drop("times")
            patterns = patterns.join(kept, "pattern", "left_anti")
    sizes = [r["n"] for r in patterns.select(F.least(F.length("pattern"), F.lit(q)).alias("n")).distinct().orderBy("n").collect()]
    if sizes:
        own = patterns.withColumn("g", F.explode(F.array_distinct(F.when(F.length("pattern") <= q, F.array("pattern")).otherwise(grams(F.col("pattern"), q)))))
        rest = _kept(_rarest(own, _times(some, False, sizes))).drop("times")
        return rest if kept is None else kept.unionByName(rest), kept is not None, sizes
    return kept, True, []


def _bitmap(index: DataFrame) -> Column:
    """A predicate on ``gram``: false only where no pattern has this key."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    size = 32_768  # bits of one of Spark's bitmaps
    rows = index.select(at("gram").alias("h")).groupBy(F.floor(F.col("h") / size).alias("b")).agg(F.bitmap_construct_agg(F.col("h") % size).alias("bits")).collect()
    whole = bytearray(BITS // 8)
    for r in rows:
        whole[r["b"] * size // 8 : (r["b"] + 1) * size // 8] = r["bits"]
    byte = F.conv(F.hex(F.substr(F.lit(bytes(whole)), (F.floor(at("gram") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.shiftrightunsigned(byte, 0) / F.pow(F.lit(2), at("gram") % 8), F.lit(2)) >= 1


def contained(texts: DataFrame, patterns: DataFrame, q: int = 5, few: int = 100_000, share: int = SHARE, per_text: int = PER_TEXT) -> DataFrame:
    """(key, pattern, payload): a row for each of ``texts`` (key, body) and each of ``patterns`` (pattern, payload) that stands in its body.

    Null and empty bodies hold nothing, empty patterns are in none.
    """
    texts, patterns = texts.select("key", "body"), patterns.select("pattern", "payload").where("pattern <> ''").distinct()
    count = patterns.limit(few + 1).count()
    if not count:
        return texts.select("key").join(patterns, F.lit(False))
    index, by_words, sizes = index_of(texts, patterns, q, share, per_text)
    index = index.join(patterns, "pattern").select("gram", "pattern", "payload")
    keys = F.explode(_keys(F.col("body"), by_words, sizes)).alias("gram")
    if count <= few:  # at most ``few`` rows: the body stays where it was read and made, and isn't exchanged
        return texts.select("key", "body", keys).join(F.broadcast(index), "gram").where(F.contains("body", "pattern")).select("key", "pattern", "payload")
    met = texts.select("key", keys).where(_bitmap(index)).join(index, "gram")
    asked = met.groupBy(F.col("key").alias("__key")).agg(F.collect_set(F.struct("pattern", "payload")).alias("asked"))
    rows = texts.join(asked, F.col("key").eqNullSafe(F.col("__key")))
    # the outer form: a plain explode puts a filter with the lambda into the join, where Spark can't bind it
    return rows.select("key", F.explode_outer(F.filter("asked", lambda p: F.contains("body", p["pattern"]))).alias("p")).select("key", "p.pattern", "p.payload").where("pattern is not null")
