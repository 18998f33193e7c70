"""Benchmark decontamination by spaced-seed hashing (operator 6), DataFrame functions only.

Texts and benchmark items become words (runs of letters and digits, in lower case; single characters in scripts that don't part words by spaces) and these
64-bit hashes. A seed is the hash of the
words at the places of one mask; masks ignore other places, so a substitution there doesn't matter. Seeds of texts and of
items are joined, and around each hit the words are compared place by place: an item leaks into a text if in some ``WINDOW``
aligned words (all words, for a shorter item) at most ``tolerance`` differ. With ``MASKS`` every such window has a
hit, so none is missed: four substitutions in 16 words, none in fewer than 8. An item too short for a mask (fewer than
``LEAST_WORDS`` words) leaks only into texts that are nothing but it; its seed is the hash of all words.

Before anything is exploded, two bit sets (first pairs of words, then seeds) drop the
places of a text that can't hit. They grow with the items, ``BITS_A_SEED`` for each seed, up to 2**MOST_BITS bits, from which on they let
through more; nothing is ever lost. The items' seeds are broadcast
only up to ``MOST_BROADCAST`` of them (some 40 MB), else joined by a shuffle.

Null texts and texts without words are never found, nor are such items. Texts are read whole, however long. Repeated rows of a text give the
same pair once. Rows with a null key are neither found nor dropped. Empty tables give no pairs. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places that each seed looks at; all begin with the same two.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 2, 3, 8), (0, 1, 6, 8, 9))
WINDOW, MOST_WRONG, LEAST_WORDS = 16, 4, 5
BITS_A_SEED, MOST_BITS, MOST_BROADCAST = 16, 25, 100_000
#: Scripts without spaces between words.
SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai")
_MAYBE = r"[\x{0E00}-\x{0E7F}\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{16F00}-\x{3FFFF}]"
_SPAN = 1 + max(o for m in MASKS for o in m)


@cache
def tolerance(words: int) -> int:
    """The most substitutions (up to MOST_WRONG, a quarter of the words) that leave a hit in any case in a window of so many words."""
    places = [[i + o for o in m] for m in MASKS for i in range(words - m[-1])]
    best = 0
    for wrong in range(1, min(MOST_WRONG, words // 4) + 1):
        if all(any(not bad & set(p) for p in places) for bad in map(set, combinations(range(words), wrong))):
            best = wrong
    return best


def words(text: Column) -> Column:
    unspaced = "[" + "".join(rf"\p{{Is{s}}}" for s in SCRIPTS) + "]"
    low = F.lower(text)
    # A range is found faster than a script; it holds all characters of these scripts.
    spaced = F.when(low.rlike(_MAYBE), F.regexp_replace(low, f"({unspaced})", " $1 ")).otherwise(low)
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seed(hashes: Column, at: Column, mask: tuple[int, ...], number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(hashes, at + o) for o in mask])


def _whole(hashes: Column) -> Column:
    """The seed of a text or item of fewer than LEAST_WORDS words, of all of them."""
    seed = F.struct(F.lit(0).alias("at"), F.xxhash64(F.lit(-1), hashes).alias("seed"))
    return F.when(F.size(hashes).between(1, LEAST_WORDS - 1), F.array(seed)).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))


def _pair(hashes: Column, at: Column) -> Column:
    return F.get(hashes, at).bitwiseXOR(F.shiftleft(F.get(hashes, at + 1), 1))


def _starts(count: Column, span: int) -> Column:
    """0 .. count - span, or nothing."""
    return F.when(count >= span, F.sequence(F.lit(0), count - span)).otherwise(F.array().cast("array<int>"))


def _around(hashes: Column, at: Column) -> Column:
    """The words in every window that holds a hit at a place; null beyond the ends."""
    return F.transform(F.sequence(F.lit(1 - WINDOW), F.lit(WINDOW + _SPAN - 2)), lambda d: F.get(hashes, at + d))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: a generator keeps the optimizer from copying it into lambdas that use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _hashed(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias(name), F.col(text).alias("t"))
    return _once(rows, "h", F.transform(words(F.col("t")), lambda w: F.xxhash64(w))).drop("t")


def item_seeds(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item``, ``seed``, ``pair``, ``theirs`` (the words around), ``window``, ``least`` of all places and masks of all items."""
    hashed = _hashed(items, key, text, "item")
    sized = hashed.where(F.size("h") > 0).withColumn("n", F.size("h")).withColumn("window", F.least("n", F.lit(WINDOW)))
    least = reduce(lambda out, n: F.when(F.col("window") == n, n - tolerance(n)).otherwise(out), range(LEAST_WORDS, WINDOW + 1), F.col("window"))

    def places(mask: tuple[int, ...], number: int) -> Column:
        return F.transform(_starts(F.col("n"), mask[-1] + 1), lambda i: F.struct(i.alias("at"), _seed(F.col("h"), i, mask, number).alias("seed")))

    seeds = sized.select("item", "h", "window", least.alias("least"), F.explode(F.concat(_whole(F.col("h")), *[places(m, k) for k, m in enumerate(MASKS)])).alias("s"))
    return seeds.select("item", F.col("s.seed").alias("seed"), _pair(F.col("h"), F.col("s.at")).alias("pair"), _around(F.col("h"), F.col("s.at")).alias("theirs"), "window", "least")


@dataclass
class BitSet:
    words: Column
    bits: int

    @classmethod
    def of(cls, values: DataFrame, count: int) -> BitSet:
        """A constant array of bits, in which each of ``count`` rows' ``v`` (bigint) has its own set. One word for each 64 bits at most reaches the driver."""
        bits = min(max(12, (BITS_A_SEED * max(count, 1) - 1).bit_length()), MOST_BITS)
        cell = F.shiftrightunsigned("v", 64 - bits)
        rows = values.select(F.shiftright(cell, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (cell % 64).cast("int")).alias("b"))
        found = {r.w: r.b for r in rows.groupBy("w").agg(F.bit_or("b").alias("b")).collect()}
        return cls(F.from_json(F.lit("[" + ",".join(str(found.get(k, 0)) for k in range(1 << (bits - 6))) + "]"), "array<bigint>"), bits)

    def has(self, value: Column) -> Column:
        cell = F.shiftrightunsigned(value, 64 - self.bits)
        return F.getbit(F.get(self.words, F.shiftright(cell, 6).cast("int")), (cell % 64).cast("int")) == 1


def bit_sets(seeds: DataFrame, count: int) -> tuple[BitSet, BitSet]:
    """Those of the first pairs of words, and of the seeds."""
    return BitSet.of(seeds.select(F.xxhash64("pair").alias("v")), -(-count // len(MASKS))), BitSet.of(seeds.select(F.col("seed").alias("v")), count)


def passing(hashed: DataFrame, pairs: BitSet, marks: BitSet) -> DataFrame:
    """``doc``, ``h``, ``s`` (array of ``at`` and ``seed``): the seeds of texts that the bit sets let through."""
    h = F.col("h")
    # A place counts for masks that reach beyond the end too: a hash with missing words is no seed of an item, or fails the comparison.
    begun = _once(hashed, "at", F.filter(_starts(F.size("h"), MASKS[0][-1] + 1), lambda i: pairs.has(F.xxhash64(_pair(h, i)))))
    made = F.flatten(F.transform("at", lambda i: F.array(*[F.struct(i.alias("at"), _seed(h, i, m, k).alias("seed")) for k, m in enumerate(MASKS)])))
    return _once(_once(begun, "made", F.concat(_whole(h), made)), "kept", F.filter("made", lambda s: marks.has(s["seed"]))).select("doc", "h", F.col("kept").alias("s"))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key``, ``item_key``, ``first_word`` (place in the text of the first hit), ``matched`` (most equal words in a window): one row a pair."""
    seeds = item_seeds(items, item_key, item_text)
    count = seeds.count()
    pairs, marks = bit_sets(seeds, count)
    kept = passing(_hashed(docs, key, text, "doc"), pairs, marks)
    hits = kept.select("doc", "h", F.explode("s").alias("s")).select("doc", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"), _around(F.col("h"), F.col("s.at")).alias("ours"))
    if count <= MOST_BROADCAST:
        seeds = F.broadcast(seeds)
    met = hits.join(seeds, "seed")
    same = F.zip_with("ours", "theirs", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    begins = F.sequence(F.lit(1), F.lit(2 * WINDOW + _SPAN - 2) - F.col("window") + 1)
    most = F.array_max(F.transform(begins, lambda s: F.aggregate(F.slice("same", s, F.col("window")), F.lit(0), lambda a, x: a + x)))
    checked = _once(met, "same", same)
    checked = _once(checked, "most", most)
    found = checked.where(F.col("most") >= F.col("least"))
    return found.groupBy(F.col("doc").alias(key), F.col("item").alias(item_key)).agg(F.min("at").alias("first_word"), F.max("most").alias("matched"))


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item leaks into, with their columns."""
    gone = leaks(docs, items, key, text, item_key, item_text).select(F.col(key)).distinct()
    return docs.join(gone, key, "left_anti").select(*docs.columns)
