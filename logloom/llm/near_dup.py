"""Near-duplicate documents: banded MinHash candidates, odd sketches, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    FEW,
    components,
    gram_hashes,
    maybe_among,
    multipliers,
    one_per_key,
    row_key,
    saved,
    without_rows,
    word_hashes,
)

# MinHash samples per set: BANDS bands of ROWS samples. A pair at similarity 0.8
# shares no band once in 1.6 million times.
BANDS, ROWS = 36, 5
# Bits of an odd sketch, kept as 64-bit numbers.
SKETCH_BITS = 1024
# A candidate goes on to exact confirmation if its sketches say at least the
# threshold less this margin, nearly five standard deviations of the estimate.
MARGIN = 0.15
# Members of a bucket that are compared by sketch at a time, and rows of a task.
BLOCK, TASK_ROWS = 2048, 8192
# Members of a cluster that are compared on their full sets at a time, shingles of
# such a block, and shingles of a task.
SET_BLOCK, SET_SHINGLES, TASK_SHINGLES = 512, 1 << 20, 1 << 22
# Texts of a task that makes sets of them, at most.
TASK_TEXTS = 1024
# Pairs per bucket member up to which all pairs between components are compared
# at once, without a look at the nearest ones first.
FEW_PAIRS = 2

_WORDS = SKETCH_BITS // 64


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """Per text, sorted distinct hashes of its word shingles; fewer words are one shingle."""
    factors = multipliers(size, 1)
    for words in word_hashes([(text or b"").lower() for text in texts]):
        if len(words) >= size:
            grams = np.sort(gram_hashes(words, size, factors))
            yield grams[np.concatenate(([True], grams[1:] != grams[:-1]))]
        elif len(words):
            # Another seed per length, so that short texts equal only each other.
            yield gram_hashes(words, len(words), multipliers(len(words), 100 + len(words)))
        else:
            yield words


def _signatures(size: int):
    samples = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = multipliers(2 * samples, 2)
        a = (wide[:samples] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        b = (wide[samples:] >> np.uint64(32)).astype(np.uint32)
        band_seed = multipliers(BANDS, 3)[:, None]
        band_factors = multipliers(ROWS, 4)
        spot_factors = (multipliers(samples, 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        for batch in batches:
            keys_in, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            counts, prints, bands, sketches = [], [], [], []
            for grams in shingle_sets(texts, size):
                counts.append(len(grams))
                if not len(grams):
                    prints.append(None), bands.append(None), sketches.append(None)
                    continue
                prints.append(xxhash.xxh3_128_digest(grams.tobytes()))
                short = (grams >> np.uint64(32)).astype(np.uint32)
                least = np.full(samples, 0xFFFFFFFF, np.uint32)
                for i in range(0, len(short), 2048):
                    part = np.multiply.outer(a, short[i : i + 2048])
                    part += b[:, None]
                    np.minimum(least, part.min(axis=1), out=least)
                rows = least.reshape(BANDS, ROWS).astype(np.uint64) + band_seed
                keys = (rows * band_factors).sum(axis=1, dtype=np.uint64)
                keys ^= keys >> np.uint64(29)
                keys *= np.uint64(0x9E3779B97F4A7C15)
                bands.append(keys.view(np.int64))
                spots = (least ^ (least >> np.uint32(15))) * spot_factors
                spots = (spots ^ (spots >> np.uint32(13))) * np.uint32(0x9E3779B1)
                odd = np.bincount(spots >> np.uint32(22), minlength=SKETCH_BITS) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    keys_in,
                    pa.array(counts, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["key", "n_shingles", "print", "bands", "sketch"],
            )

    return run


def sketch_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity that two odd sketches tell, from the population count of their XOR.

    An element of the symmetric difference of the MinHash samples flips one bit, so
    the number of odd bits says how many elements there are.
    """
    odd = sum(
        (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, _WORDS)),
        F.bit_count(a[0].bitwiseXOR(b[0])),
    )
    share = F.greatest(1 - 2 * odd / SKETCH_BITS, F.lit(1e-9))
    return 1 + SKETCH_BITS / (4.0 * BANDS * ROWS) * F.log(share)


def _maybe_named(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Those `rows` (`key`) whose key is in `keys` (`of`), and a few others."""
    return maybe_among(rows, "key", keys, "of").filter("maybe").drop("maybe")


def _with_sets(named: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The full sets (`node`, `grams`) of the classes `named` (`node`, `key`) in `rows`.

    Up to `FEW` keys, which are counted first, are sent to the texts, so that only texts that
    are needed are shuffled; beyond that those that a map of the keys does not rule out are.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            grams = [found.view(np.int64) for found in shingle_sets(texts, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grams, pa.list_(pa.int64()))], ["node", "grams"]
            )

    keys = saved(named.select("node", F.col("key").alias("of")), "near-dup-named")
    # A row may repeat very often, and its text is needed once.
    n = keys.count()
    if n <= FEW:
        found = rows.join(F.broadcast(keys), F.col("key") == F.col("of"))
    else:
        found = _maybe_named(rows, keys).join(keys, F.col("key") == F.col("of"))
    found = found.groupBy("node").agg(F.first("text")).coalesce(-(-n // TASK_TEXTS) + 3)
    return found.mapInArrow(sets, "node bigint, grams array<bigint>")


def _confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the different `pairs` (`a`, `b`) whose full shingle sets are similar enough."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    full = _with_sets(classes.join(needed, "node"), rows, size)
    left = full.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    right = full.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - both
    return (
        pairs.select("a", "b").join(left, "a").join(right, "b")
        .filter(100 * both.cast("bigint") >= percent * union.cast("bigint"))
        .select("a", "b")
    )


def _runs(*keys: np.ndarray) -> list[np.ndarray]:
    """The places of the rows with equal `keys`, one array per group."""
    order = np.lexsort(keys)
    differ = np.zeros(max(len(order) - 1, 0), bool)
    for key in keys:
        differ |= np.diff(key[order]) != 0
    return np.split(order, np.flatnonzero(differ) + 1)


def _spanning(linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what `linked` (rows `x`, columns `y`) connects."""
    roots, ends = [], []
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    while rows.any():
        root = front = np.flatnonzero(rows)[:1]
        rows[front] = False
        while len(front):
            met = np.flatnonzero(linked[front].any(axis=0) & cols)
            cols[met] = False
            front = np.flatnonzero(linked[:, met].any(axis=1) & rows)
            rows[front] = False
            ends += [y[met], x[front]]
            roots.append(np.repeat(x[root], len(met) + len(front)))
    if not roots:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(roots), np.concatenate(ends)


def _odd_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Population counts of the XOR of all sketches of `a` with all of `b`."""
    signs = [
        np.unpackbits(x.view(np.uint8), axis=1).astype(np.float32) * 2 - 1 for x in (a, b)
    ]
    return (SKETCH_BITS - signs[0] @ signs[1].T) / 2


def _sides(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the first and the second block of every comparison of a task."""
    key, bi, bj, block = (table[c].to_numpy() for c in ("key", "bi", "bj", "block"))
    for at in _runs(key, bi, bj):
        first, second = at[block[at] == bi[at]], at[block[at] == bj[at]]
        if len(first) and len(second):
            yield first, second


def _compared(percent: int, nearest: bool):
    """Compare the members of blocks of buckets by their sketches.

    Gives stars that connect all members of different labels that may be similar
    enough, or the nearest such partner of each member.
    """
    least = percent / 100 - MARGIN
    most = SKETCH_BITS / 2 * (1 - np.exp(-(1 - least) * 4 * BANDS * ROWS / SKETCH_BITS))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, labels, sizes = (table[c].to_numpy() for c in ("node", "label", "n_shingles"))
        sketches = table["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, _WORDS)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for first, second in _sides(table):
            odd = _odd_bits(sketches[first], sketches[second])
            low = np.minimum.outer(sizes[first], sizes[second])
            high = np.maximum.outer(sizes[first], sizes[second])
            near = (odd <= most) & (100 * low >= percent * high)
            near &= labels[first][:, None] != labels[second]
            if not nearest:
                a, b = _spanning(near, nodes[first], nodes[second])
                found.append((a, b, np.zeros(len(a))))
                continue
            odd[~near] = np.inf
            for x, y, far in ((first, second, odd), (second, first, odd.T)):
                best = far.argmin(axis=1)
                told = far[np.arange(len(x)), best]
                some = np.isfinite(told)
                found.append((nodes[x][some], nodes[y][best[some]], told[some]))
        a, b, odd = (np.concatenate(c) for c in zip(*found))
        return pa.table({"a": a, "b": b, "odd": odd.astype(np.float64)})

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements every set of `a` has in common with every one of `b`."""
    values = [np.concatenate(side) for side in (a, b)]
    shared = np.intersect1d(*(np.unique(v) for v in values), assume_unique=True)
    sides = []
    for value, sets in zip(values, (a, b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, value)
        own = np.flatnonzero(at < len(shared))
        own = own[shared[at[own]] == value[own]]
        order = own[np.argsort(at[own], kind="stable")]
        sides.append((row[order], at[order]))
    total = np.zeros((len(a), len(b)))
    step = 4096
    for low in range(0, len(shared), step):
        dense = []
        for (row, at), sets in zip(sides, (a, b)):
            x, y = np.searchsorted(at, [low, low + step])
            part = np.zeros((len(sets), min(step, len(shared) - low)), np.float32)
            part[row[x:y], at[x:y] - low] = 1
            dense.append(part)
        total += dense[0] @ dense[1].T
    return total


def _similar(percent: int):
    """Stars that connect all members of different labels whose full sets are similar enough."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, labels = (table[c].to_numpy() for c in ("node", "label"))
        grams = table["grams"].combine_chunks()
        values, offsets = grams.values.to_numpy(), grams.offsets.to_numpy()
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for first, second in _sides(table):
            other = labels[first][:, None] != labels[second]
            if not other.any():
                continue
            sets = [[values[offsets[i] : offsets[i + 1]] for i in x] for x in (first, second)]
            both = _common(*sets)
            sizes = [np.array([len(s) for s in x]) for x in sets]
            union = np.add.outer(*sizes) - both
            linked = (100 * both >= percent * union) & other
            found.append(_spanning(linked, nodes[first], nodes[second]))
        a, b = (np.concatenate(c) for c in zip(*found))
        return pa.table({"a": a, "b": b})

    return run


def _in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """`members` (`key`, `node`), once per pair (`bi`, `bj`) of blocks of their `key` that holds theirs."""
    last = F.col("blocks") - 1
    return (
        members.withColumn("blocks", blocks.cast("bigint"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("bi", F.least("block", "other"))
        .withColumn("bj", F.greatest("block", "other"))
        .drop("other", "blocks")
    )


def _dealt(rows: DataFrame, tasks: int):
    """`rows` grouped so that a task has several small comparisons, and none is split."""
    part = F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(4 * tasks))
    return rows.withColumn("part", part).repartition(tasks, "part").groupBy("part")


def _signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row of `docs`: its key and id, and what is told of its set."""
    id_type = docs.schema[id_col].dataType.simpleString()
    return saved(
        docs.select(row_key(id_col, F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
        .mapInArrow(
            _signatures(size),
            f"key struct<id:{id_type},content:bigint>, n_shingles bigint, print binary, "
            "bands array<bigint>, sketch array<bigint>",
        )
        .select("key", "key.id", "n_shingles", "print", "bands", "sketch"),
        "near-dup-signed",
    )


def _classes(signed: DataFrame) -> DataFrame:
    """Equal sets of `signed` as one class: `node`, `key` of its first row, and what is told of it.

    Numbers in the order of the ids stand for the classes, as an id may have several.
    Rows without an id come last.
    """
    classes = (
        signed.filter("print IS NOT NULL")
        .groupBy("print")
        .agg(
            F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("key"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
    )
    ordered = classes.orderBy(F.col("key.id").isNull(), "key.id", "key.content", "print")
    return saved(ordered.withColumn("node", F.monotonically_increasing_id()), "near-dup-classes")


def _linked(classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Components (`node`, `component`) of those `classes` that are similar to others.

    `rows` has the texts (`key`, `text`).
    """
    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = (
        banded.groupBy("key")
        .agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    members = saved(banded.join(shared, "key"), "near-dup-buckets")
    sketches = classes.select("node", "n_shingles", "sketch")

    def side(name: str) -> DataFrame:
        return sketches.select(
            F.col("node").alias(name),
            F.col("sketch").alias(f"sketch_{name}"),
            F.col("n_shingles").alias(f"n_{name}"),
        )

    def confirmed(pairs: DataFrame) -> DataFrame:
        return saved(_confirmed(pairs, classes, rows, size, percent), "near-dup-links")

    # Each class with the pivot that it shares the most buckets with.
    stars = (
        members.filter("node != pivot")
        .groupBy("node", "pivot")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col("node").alias("b"))
        .agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("a"))
    )
    likely = saved(
        stars.join(side("a"), "a").join(side("b"), "b")
        .filter(
            (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            & (sketch_similarity(F.col("sketch_a"), F.col("sketch_b")) >= percent / 100 - MARGIN)
        )
        .select("a", "b"),
        "near-dup-pairs",
    )
    links = confirmed(likely)
    groups = components(links, "near-dup-groups", links.count())

    def labelled(found: DataFrame) -> DataFrame:
        """`found` (`node`) with its component so far as `label`."""
        joined = found.join(groups, "node", "left")
        return joined.withColumn("label", F.coalesce("component", "node")).drop("component")

    def still_apart() -> DataFrame:
        """Members of the buckets that hold more than one component, with their `label`."""
        told = labelled(members.filter("n > 2").select("key", "node"))
        parts = told.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        open_buckets = (
            parts.groupBy("key")
            .agg(
                F.count(F.lit(1)).alias("labels"),
                F.sum("c").alias("m"),
                F.sum(F.col("c") * F.col("c")).alias("squares"),
            )
            .filter("labels > 1")
        )
        return saved(told.join(open_buckets, "key"), "near-dup-apart")

    blocks = F.ceil(F.col("m") / BLOCK)

    def counted(apart: DataFrame) -> tuple:
        """Members, pairs between components, and rows after they are dealt in blocks."""
        # Each member's share of the pairs of its bucket.
        pairs = F.sum((F.col("m") - F.col("squares") / F.col("m")) / 2)
        return apart.agg(F.count(F.lit(1)), pairs, F.sum(blocks)).first()

    def compared(apart: DataFrame, n: int, nearest: bool) -> DataFrame:
        paired = _in_blocks(apart.select("key", "node", "label", "m"), blocks).drop("m")
        return _dealt(paired.join(sketches, "node"), -(-n // TASK_ROWS)).applyInArrow(
            _compared(percent, nearest), "a bigint, b bigint, odd double"
        )

    # A bucket of two is a pair with its pivot, and that pair may not be the one tried.
    twos = members.filter("n = 2 AND node != pivot").select(
        F.col("pivot").alias("a"), F.col("node").alias("b")
    )
    apart = still_apart()
    n, pairs, dealt = counted(apart)
    if n and pairs > FEW_PAIRS * n:
        # The nearest one of each first, which joins most of what belongs together.
        found = compared(apart, dealt, True)
        best = F.min(F.struct("odd", "b"))["b"].alias("b")
        links = links.unionByName(confirmed(saved(found.groupBy("a").agg(best), "near-dup-nearest")))
        groups = components(links, "near-dup-groups", links.count())
        apart = still_apart()
        n, _, dealt = counted(apart)
    # What the sketches connect beyond that are clusters, and these are compared on full sets.
    edges = _apart_pairs(twos, groups).join(side("a"), "a").join(side("b"), "b").filter(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (sketch_similarity(F.col("sketch_a"), F.col("sketch_b")) >= percent / 100 - MARGIN)
    ).select("a", "b").join(likely, ["a", "b"], "left_anti")
    if n:
        edges = edges.unionByName(compared(apart, dealt, False).select("a", "b"))
    edges = saved(edges.distinct(), "near-dup-edges")
    n = edges.count()
    if not n:
        return groups
    clusters = components(edges, "near-dup-clusters", n).withColumnRenamed("component", "key")
    roots = clusters.select("key").distinct().select(F.col("key").alias("node"), "key")
    told = labelled(clusters.unionByName(roots)).join(
        classes.select("node", "n_shingles"), "node"
    )
    totals = told.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("shingles")
    )
    set_blocks = F.greatest(F.ceil(F.col("m") / SET_BLOCK), F.ceil(F.col("shingles") / SET_SHINGLES))
    dealt = totals.agg(F.sum(F.col("shingles") * set_blocks)).first()[0]
    full = _with_sets(classes.join(told.select("node"), "node", "left_semi"), rows, size)
    paired = _in_blocks(told.join(totals, "key"), set_blocks)
    late = _dealt(
        paired.select("key", "node", "label", "bi", "bj", "block").join(full, "node"),
        -(-dealt // TASK_SHINGLES),
    ).applyInArrow(_similar(percent), "a bigint, b bigint")
    links = links.unionByName(saved(late, "near-dup-late"))
    return components(links, "near-dup-groups", links.count())


def _apart_pairs(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those of `pairs` (`a`, `b`) that lie in different components."""
    a, b = (
        groups.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        for side in ("a", "b")
    )
    told = pairs.distinct().join(a, "a", "left").join(b, "b", "left")
    return told.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    percent: int = 80,
) -> DataFrame:
    """Groups of documents that are linked by a Jaccard similarity of `percent` or more.

    Words are runs of anything but ASCII white space, with A-Z in lower case; the
    set of a document is its distinct `shingle`-word shingles, or its whole word
    sequence if it has fewer words. Returns per row: its key, the id, `n_shingles`,
    `component_id` (the smallest id that links reach, its own included) and
    `kept` (is it that smallest one).

    Equal sets are one class and take part once. Classes meet in the buckets of
    MinHash bands. Each is compared with one pivot first, the smallest member of the
    buckets that it shares most of with it. Where a bucket still holds several
    components, its members are compared by sketch in blocks: first each one with
    its nearest partner in another component, then all of different components.
    Blocks give spanning stars of what their odd sketches do not rule out, and never
    the pairs; the clusters that these stars make are compared on their full sets,
    in blocks as well. So a group of thousands of near copies gives rows in the
    order of its size, not of its square.

    The bands are made for similarities of 0.8 and more, so `percent` must be 80 or
    more. Texts that are null or without words have an empty set, link with nothing
    and are kept. Rows without an id are not linked, have no component, and are kept.
    Repeated rows get the same result each; rows that share an id but not a text
    are judged by their own texts. An empty table gives an empty result. Other
    columns are not looked at.
    """
    if not 80 <= percent <= 100:
        raise ValueError(f"percent must be 80 to 100, got {percent}")
    signed = _signed(docs, id_col, text_col, shingle)
    classes = _classes(signed.filter("id IS NOT NULL"))
    rows = docs.select(row_key(id_col, F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    groups = _linked(classes, rows, shingle, percent)
    ids = classes.select(F.col("node").alias("component"), F.col("key.id").alias("root"))
    roots = (
        classes.select("print", "node").join(groups, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(ids, "component")
        .select("print", "root")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return (
        signed.select("key", "id", "n_shingles", "print")
        .join(roots, "print", "left")
        .select(
            "key",
            F.col("id").alias(id_col),
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def keep_one_per_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4
) -> DataFrame:
    """One row of `docs` per group of near duplicates: the one of the smallest id.

    Rows are told apart by id and text, so rows that share an id are linked by their
    own texts only. Rows without an id take part like others and come after all that
    have one. Rows that repeat (same id and text) are one row, with or without words.
    Null and empty texts are kept, an empty table gives an empty one, and other columns
    stay as they are, whatever their names.
    """
    signed = _signed(docs, id_col, text_col, shingle)
    classes = _classes(signed)
    rows = docs.select(row_key(id_col, F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    groups = _linked(classes, rows, shingle, 80)
    roots = (
        classes.select("key", "node").join(groups, "node", "left")
        .filter(F.coalesce("component", "node") == F.col("node"))
        .select(F.col("key").alias("root"))
    )
    dropped = signed.filter("print IS NOT NULL").join(
        roots, F.col("key") == F.col("root"), "left_anti"
    )
    return one_per_key(without_rows(docs, dropped, id_col, text_col), id_col, text_col)
