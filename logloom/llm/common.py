"""What several operators share: scratch tables, row keys, words and shingle hashes.

Functions that run on the executors are sent there by value (see `__init__`),
so the package need not be installed on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import scratch_dir

MASK = (1 << 64) - 1
# Odd multipliers of the mixing step of `mixed` (the finalizer of splitmix64).
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
# Bits per key of the map that tells which rows may be needed, and of the map at most.
KEY_BITS, MOST_BITS = 16, 1 << 28
# Bits of a row of that map, which Spark fixes.
_MAP_ROW = 1 << 15
# Rows up to which a counted table of pairs or keys is sent around, and rows of a task of such a table.
FEW, FEW_ROWS = 250_000, 8192


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` to a new table in the shared folder and read it back.

    Cuts the lineage: what follows no longer depends on shuffle files, so a lost
    executor costs the tasks it was running and nothing before them.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    schema = df.schema
    df.write.parquet(path + "/table")
    return spark.read.schema(schema).parquet(path + "/table")


def row_key(id_col: str, content: Column) -> Column:
    """Key of a row: its id and a hash of its content, as one struct.

    Structs compare with nulls equal, so rows without an id join too. Rows with
    the same id and content get the same key, and the same result.
    """
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(content).alias("content"))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is, or starts with, it.

    So names that are built on it are free too.
    """
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


def without_rows(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` without the rows whose key is in `dropped` (`key`)."""
    own = fresh(docs, "row_key")
    keyed = docs.withColumn(own, row_key(id_col, F.col(text_col)))
    keys = dropped.select(F.col("key").alias(f"{own}_dropped")).distinct()
    return keyed.join(keys, F.col(own) == F.col(f"{own}_dropped"), "left_anti").drop(own)


def one_per_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` with one row of those that have the same id and text.

    Keys are counted without the texts; only rows that repeat are shuffled.
    """
    own = fresh(docs, "row_key")
    keyed = docs.withColumn(own, row_key(id_col, F.col(text_col)))
    repeated = saved(
        keyed.groupBy(F.col(own).alias(f"{own}_repeated"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n"),
        "repeated-rows",
    )
    if repeated.isEmpty():
        return docs
    same = F.col(own) == F.col(f"{own}_repeated")
    once = keyed.join(repeated, same, "left_anti")
    folded = keyed.join(repeated, same, "left_semi").dropDuplicates([own])
    return once.unionByName(folded).drop(own)


def maybe_among(rows: DataFrame, column: str, keys: DataFrame, of: str) -> DataFrame:
    """`rows` with a boolean `maybe`: false only where `column` is in no row of `keys` (`of`).

    A map with a bit per hash of a key is sent to the rows, so that those nobody needs are
    not shuffled to find that out. A few others are told true. `keys` is a table that is cheap to read.
    """
    n = keys.count()
    size = min(MOST_BITS, _MAP_ROW * max(1, -(-KEY_BITS * n // _MAP_ROW)))

    def spot(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(size)) + 1

    bits = (
        keys.select(spot(of).alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("in_row"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    )
    place = F.bitmap_bit_position(spot(column))
    byte = F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))
    bit = F.pmod(place, F.lit(8)).cast("int")
    found = F.call_function("getbit", F.conv(F.hex(byte), 16, 10).cast("bigint"), bit)
    return rows.join(
        F.broadcast(bits), F.bitmap_bucket_number(spot(column)) == F.col("in_row"), "left"
    ).select(*rows.columns, F.coalesce(found == 1, F.lit(False)).alias("maybe"))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """`n` odd 64-bit numbers that depend on nothing but `seed`."""
    numbers = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
    return numbers | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, computed once per word. Emptied when it grows large."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
# The first bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Bytes beyond which a word is hashed on its own, and of short texts that are taken at once.
_LONG, _AT_ONCE = 4096, 1 << 19


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of each text, which are runs of anything but ASCII white space."""
    low = 0
    while low < len(texts):
        high, size = low + 1, len(texts[low])
        while high < len(texts) and size + len(texts[high]) <= _AT_ONCE:
            size += len(texts[high])
            high += 1
        borders = np.cumsum([len(text) + 1 for text in texts[low:high]])
        at, hashes = _words_hashed(b" ".join(texts[low:high]))
        yield from np.split(hashes, np.searchsorted(at, borders[:-1]))
        low = high


def _words_hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start, and their hashes.

    Eight bytes of all words at once are mixed into what came before them, the length first.
    """
    space = np.ones(len(text) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, left = edges[::2], edges[1::2] - edges[::2]
    hashes = mixed(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(left > _LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(text[starts[i] : starts[i] + left[i]])
    eights = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    which = np.flatnonzero(left <= _LONG)
    at, left = starts[which], left[which]
    while len(which):
        part = eights[at] & _FIRST[np.minimum(left, 8)]
        hashes[which] = mixed(hashes[which] ^ part)
        more = np.flatnonzero(left > 8)
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return starts, hashes


def gram_hashes(words: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words; `factors` has `size` odd numbers."""
    n = len(words) - size + 1
    total = words[:n] * factors[0]
    for j in range(1, size):
        total += words[j : j + n] * factors[j]
    return mixed(total)


def components(edges: DataFrame, purpose: str, rows: int | None = None) -> DataFrame:
    """Connected components of `edges` (`a`, `b`): columns `node`, `component`.

    The component is the smallest node. Every round hangs each node's larger
    neighbours on its smallest one, then each node's smaller neighbours; a few
    rounds turn every component into a star. Minima combine before the shuffle
    and meet the edges in a join, so a node with very many edges is split. Up to
    `FEW` edges, which are counted first, minima are sent around instead, and a round is
    dealt to as many tasks as its rows need. Each round is a table in the shared folder.
    `rows` says how many rows `edges` has, where that is known.
    """

    def tasks(pairs: int | None) -> int | None:
        return -(-pairs // FEW_ROWS) + 3 if pairs is not None and pairs <= FEW else None

    def dealt(df: DataFrame, n: int | None) -> DataFrame:
        return df.coalesce(n) if n else df

    def least_of(pairs: DataFrame, n: int | None) -> DataFrame:
        least = dealt(pairs.groupBy("a").agg(F.min("b").alias("m")), n)
        return F.broadcast(least) if n else least

    def stars(pairs: DataFrame, n: int | None) -> DataFrame:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.filter("b > a")
            .join(least_of(both, n), "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        )
        least = least_of(large, n).withColumnRenamed("a", "n")
        joined = large.join(least, F.col("a") == F.col("n"))
        small = joined.select(
            F.explode(
                F.array(
                    F.struct("a", F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        return small.select("e.a", "e.b").filter("a != b").distinct()

    def kept(pairs: DataFrame, n: int | None) -> tuple[DataFrame, int]:
        """The pairs as a table, and how many they are."""
        seen = Observation()
        table = saved(dealt(pairs, n).observe(seen, F.count(F.lit(1)).alias("n")), purpose)
        return table, seen.get["n"]

    def are_stars(pairs: DataFrame, n: int | None) -> bool:
        """Does every node hang on one other at most, and none that others hang on?"""
        roles = pairs.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
            pairs.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
        )
        told = roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        wrong = told.filter("hangs > 1 OR hangs = 1 AND holds = 1")
        return not dealt(wrong, n).count()

    current, n = kept(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a != b")
        .distinct(),
        tasks(rows),
    )
    while not are_stars(current, tasks(n)):
        current, n = kept(stars(current, tasks(n)), tasks(n))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
