"""The trie of shared conversation prefixes, by van Emde Boas recursion over depths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

# Fixed values of the contract: a conversation starts with the first turns of that
# of its hundred, as many as the CRC of its decimal number says, modulo 6.
GROUP, HEADS = 100, 6
# Ids whose decimals are joined before they go on to the digest of a node.
CHUNK = 4096

_EMPTY = hashlib.sha256(b"").hexdigest()


def _both(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """`conv`, `pos` (from 1), `digest`, `cp`: turns in order, also of very long conversations.

    Conversations and their orders are sorted by range, so one conversation may be
    spread over many tasks. A turn's number is its place in its range plus
    what earlier ranges have of its conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    read = saved(
        turns.filter(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("bigint").alias("conv"),
            "turn",
            role.alias("role"),
            # The length of the role keeps the two apart.
            F.unhex(
                F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
            ).alias("digest"),
            F.char_length(text).cast("bigint").alias("cp"),
        ),
        "trie-turns",
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
    ranged = saved(
        read.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "conv", "digest", "cp",
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
        ),
        "trie-order",
    )
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("conv", "part")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .drop("n")
    )
    return ranged.join(starts, ["conv", "part"]).select(
        "conv", (F.col("place") - F.col("first") + F.col("ahead") + 1).alias("pos"), "digest", "cp"
    )


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (`conv`, `total`) and their turns (`conv`, `total`, `depth`, ...)."""
    conv = F.col("conv")
    heads = (
        turns.filter((conv % GROUP == 0) & (F.col("pos") < HEADS))
        .groupBy(conv.alias("base"))
        # At most five turns of a conversation.
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "cp"))).alias("head"))
    )
    plans = saved(
        turns.groupBy("conv")
        .agg(F.max("pos").alias("n"))
        .withColumn("h", F.crc32(conv.cast("string")) % HEADS)
        .withColumn("base", conv - conv % GROUP)
        .join(heads, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce(F.size("head"), F.lit(0))).cast("bigint"))
        .select(
            "conv",
            "h",
            "taken",
            (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"),
            F.slice(F.coalesce("head", F.expr("array()")), F.lit(1), F.col("taken").cast("int")).alias("head"),
        ),
        "trie-plans",
    )
    first = plans.select("conv", "total", F.explode("head").alias("t")).select(
        "conv", "total", F.col("t.pos").alias("depth"), "t.digest", "t.cp"
    )
    own = (
        turns.join(plans.select("conv", "h", "taken", "total"), "conv")
        .filter("pos > h")
        .select("conv", "total", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "cp")
    )
    return plans.select("conv", "total"), first.unionByName(own)


def _segments(turns: DataFrame, levels: int) -> DataFrame:
    """Per conversation and depth: a hash of the turns from the last cut above it.

    The cut above a depth m is m less its lowest binary digit: the middle that the
    recursion names before it comes to m. A turn counts at one depth per level at most.
    Turns enter with their place, by exclusive or of 128 bits, so that partial
    sums combine before they are shuffled, however long a conversation is.
    """
    v = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("v")
    up = F.expr("(depth + shiftleft(1L, v) - 1) div shiftleft(1L, v)")
    at = turns.select("*", v).withColumn("up", up).filter("up % 2 = 1")
    at = at.withColumn("m", F.expr("shiftleft(up, v)")).filter("m <= total")
    here = F.col("depth") == F.col("m")
    return at.groupBy("conv", "m").agg(
        F.bit_xor(F.xxhash64("digest", "depth", F.lit(1))).alias("s1"),
        F.bit_xor(F.xxhash64("digest", "depth", F.lit(2))).alias("s2"),
        F.max(F.when(here, F.col("cp"))).alias("cp"),
        F.max(F.col("total") == F.col("m")).alias("ends"),
    )


def _named(segments: DataFrame, levels: int) -> DataFrame:
    """`conv`, `depth`, `name`, `cp`, `ends`: the prefix of every conversation at every depth.

    The name of a prefix is the smallest conversation that has it. All sequences are cut
    at half of the depth, and the prefixes there are named; what is above the cut, and
    what hangs below each of its names, are cut at their halves in the same round,
    and so on down to single turns: a round for each level, whatever the depth.
    """
    done: list[DataFrame] = []
    for v in range(levels, -1, -1):
        step = 1 << v
        rows = segments.filter(F.col("m") % (2 * step) == step).withColumn("cut", F.col("m") - step)
        if done:
            above = _both(done).filter(F.col("depth") % (2 * step) == 0)
            above = above.select("conv", F.col("depth").alias("cut"), F.col("name").alias("under"))
            rows = rows.join(above, ["conv", "cut"], "left")
        else:
            rows = rows.withColumn("under", F.lit(None).cast("bigint"))
        # Nothing is above the first cut, and no other prefix is without a name.
        rows = rows.withColumn("under", F.coalesce("under", F.lit(0).cast("bigint")))
        key = ["m", "under", "s1", "s2"]
        names = rows.groupBy(*key).agg(F.min("conv").alias("name"))
        done.append(
            saved(
                rows.join(names, key).select("conv", F.col("m").alias("depth"), "name", "cp", "ends"),
                "trie-names",
            )
        )
    return _both(done)


def _grafted(nodes: DataFrame, named: DataFrame, levels: int) -> DataFrame:
    """Sums of `tokens` and `leaves` over subtrees, from the single turns upward.

    A round joins each upper trie to the forests below its cut: what the roots of
    a forest hold is added up at the node of the cut that they hang from, and goes to
    that node and to its ancestors within the upper trie.
    """
    totals = nodes.select("depth", "conv", "parent", "tokens", "leaves")
    for k in range(levels + 1):
        half = 1 << k
        forests = (
            totals.filter((F.col("depth") - 1) % (2 * half) == half)
            .groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("cut"))
            .agg(F.sum("tokens").alias("tokens"), F.sum("leaves").alias("leaves"))
            .withColumn("block", F.expr(f"(cut - 1) div {half}L"))
        )
        paths = named.select("conv", "depth", "name", F.expr(f"(depth - 1) div {half}L").alias("block"))
        paths = paths.filter("block % 2 = 0")
        more = forests.join(paths, ["conv", "block"]).select(
            "depth",
            F.col("name").alias("conv"),
            F.lit(None).cast("bigint").alias("parent"),
            "tokens",
            "leaves",
        )
        totals = saved(
            totals.unionByName(more)
            .groupBy("depth", "conv")
            .agg(
                F.max("parent").alias("parent"),
                F.sum("tokens").alias("tokens"),
                F.sum("leaves").alias("leaves"),
            ),
            "trie-totals",
        )
    return totals


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys start."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, as decimals with commas between them."""
    for batch in batches:
        depth, node, conv = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(conv):
            continue
        rows = []
        cuts = [*_runs([depth, node]).tolist(), len(conv)]
        for start, stop in zip(cuts, cuts[1:]):
            for at in range(start, stop, CHUNK):
                ids = conv[at : min(at + CHUNK, stop)].tolist()
                rows.append((depth[start], node[start], ids[0], ",".join(map(str, ids))))
        columns = zip(*rows)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], ["depth", "conv", "first", "ids"]
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node, fed with its chunks in order; holds one chunk at a time."""
    current, digest = None, None
    schema = ["depth", "conv", "ends_sha256"]

    def result(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        types = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], schema
        )

    for batch in batches:
        rows = []
        for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if (depth, node) == current:
                digest.update(b",")
            else:
                if current:
                    rows.append((*current, digest.hexdigest()))
                current, digest = (depth, node), hashlib.sha256()
            digest.update(ids.encode())
        yield result(rows)
    if current:
        yield result([(*current, digest.hexdigest())])


def _end_digests(ends: DataFrame) -> DataFrame:
    """`depth`, `conv`, `ends_sha256` of all nodes that a conversation (`member`) ends at.

    A digest takes its bytes in order, so one task per node reads them at last; what it
    reads are chunks of ids that were sorted and joined by range in parallel.
    """
    order = ["depth", "conv", "member"]
    chunks = (
        saved(ends.select(*order), "trie-ends")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_chunks, "depth bigint, conv bigint, first bigint, ids string")
    )
    return (
        chunks.repartition("depth", "conv")
        .sortWithinPartitions("depth", "conv", "first")
        .mapInArrow(_digests, "depth bigint, conv bigint, ends_sha256 string")
    )


def _gathered(tables: list[DataFrame], value: dict[str, Column]) -> DataFrame:
    """Columns of nodes from several tables, by one shuffle."""
    wide = []
    for table in tables:
        missing = {c: F.lit(None).cast("string" if "sha" in c else "bigint") for c in value}
        missing = {c: e for c, e in missing.items() if c not in table.columns}
        wide.append(table.withColumns(missing).select("depth", "conv", *value))
    return _both(wide).groupBy("depth", "conv").agg(*[e.alias(c) for c, e in value.items()])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    Takes `conv_id`, `turn`, `role`, `text`. Every conversation is rebuilt: the first h
    turns of the first one of its hundred, then its own turns after its first h, where h is
    the CRC-32 of its decimal number modulo 6. A node is a distinct sequence of
    first turns; it goes by its depth and by `conv_id`, the smallest conversation that
    starts with it. Returns per node: `conv_id`, `depth`, `parent_conv_id` (null at the
    root), `n_convs` (conversations that start with it), `n_children`, `n_leaves`
    (nodes of its subtree without children), `saved_tokens` (over its subtree, what
    sharing the last text saves, in code points) and `ends_sha256` (of the
    conversations that end at it, ascending, with commas).

    Depths are cut in halves as by van Emde Boas (see `_named`, `_grafted`): the number
    of rounds is the logarithm of the longest conversation, and their work together is the
    number of turns times that logarithm. Nothing is gathered per conversation, per
    prefix or per node, but for the end digests, which stream through a task.

    Null roles and texts are empty; null turns come first; turns of equal number are in the
    order of their roles and of a digest of their texts, and repeated rows are turns
    of their own. Rows without a conversation are left out. An empty table has no
    nodes. A rebuilt conversation without turns is a member of the root, and ends there.
    Other columns are not looked at.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    turns = saved(numbered_turns(rows), "trie-numbered")
    plans, rebuilt = rebuilt_turns(turns)
    known = plans.agg(
        F.min("conv").alias("root"), F.max("total").alias("most"), F.count(F.lit(1)).alias("n")
    ).first()
    root = F.lit(known["root"]).cast("bigint")
    zero = F.lit(0).cast("bigint")
    levels = max(known["most"] or 1, 1).bit_length() - 1
    named = _named(saved(_segments(rebuilt, levels), "trie-segments"), levels)

    groups = named.groupBy("depth", F.col("name").alias("conv")).agg(
        F.count(F.lit(1)).alias("n_convs"), F.max("cp").alias("cp")
    )
    above = named.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    own = saved(
        groups.join(above, ["conv", "depth"], "left").select(
            "depth",
            "conv",
            F.coalesce("parent", root).alias("parent"),
            "n_convs",
            ((F.col("n_convs") - 1) * F.col("cp")).alias("tokens"),
        ),
        "trie-nodes",
    )
    children = own.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    children = saved(children, "trie-children")
    inner = children.select("depth", "conv", F.lit(0).cast("bigint").alias("leaves"))
    nodes = own.join(inner, ["depth", "conv"], "left").withColumn(
        "leaves", F.coalesce("leaves", F.lit(1).cast("bigint"))
    )
    totals = _grafted(saved(nodes, "trie-leaves"), named, levels)

    # The root is no turn: it stands for all conversations.
    top = totals.filter("depth = 1").agg(
        F.coalesce(F.sum("tokens"), zero).alias("tokens"),
        F.greatest(F.coalesce(F.sum("leaves"), zero), F.lit(1)).cast("bigint").alias("leaves"),
    )
    top = top.filter(F.lit(known["n"] > 0)).select(
        zero.alias("depth"),
        root.alias("conv"),
        F.lit(known["n"]).cast("bigint").alias("n_convs"),
        "tokens",
        "leaves",
    )
    ends = named.filter("ends").select("depth", F.col("name").alias("conv"), F.col("conv").alias("member"))
    turnless = plans.filter("total = 0").select(
        zero.alias("depth"), root.alias("conv"), F.col("conv").alias("member")
    )
    found = _gathered(
        [
            own.select("depth", "conv", "parent", "n_convs"),
            totals.select("depth", "conv", "tokens", "leaves"),
            children,
            top,
            _end_digests(ends.unionByName(turnless)),
        ],
        {
            "parent": F.max("parent"),
            "n_convs": F.max("n_convs"),
            "n_children": F.coalesce(F.max("n_children"), zero),
            "leaves": F.max("leaves"),
            "tokens": F.max("tokens"),
            "ends_sha256": F.coalesce(F.max("ends_sha256"), F.lit(_EMPTY)),
        },
    )
    return found.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("tokens").alias("saved_tokens"),
        "ends_sha256",
    )
