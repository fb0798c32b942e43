"""Near-duplicate vectors: an exact metric range join over the cells of pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved

PIVOTS = 24
# Vectors of a cell that one task compares with as many others.
BLOCK = 4096
_ROWS = 512


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def _pivots_of(dim: int, given: dict[int, list[list[float]]]) -> np.ndarray:
    """Pivots of the vectors of a length: given ones, or else fixed directions."""
    if dim in given:
        return np.asarray(given[dim])
    return _unit(np.random.default_rng(dim).standard_normal((PIVOTS, dim)))


def _placed(vectors: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of every vector, and a matrix of the cells that it visits as a guest.

    A vector within `reach` of one whose nearest pivot is another one is within
    `reach` of the plane between the two pivots, by the triangle inequality. It
    visits such cells of a lower number; the vectors there visit its own.
    """
    near = vectors @ pivots.T
    home = near.argmax(axis=1)
    apart = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
    best = near[np.arange(len(near)), home]
    guest = best[:, None] - near <= reach * apart[home] + 1e-9
    return home, guest & (np.arange(len(pivots)) < home[:, None])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    dims = np.asarray(batch.column(0))
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim))
        yield int(dim), _unit(_matrix(part.column(3))), part


def _counted(given: dict[int, list[list[float]]], reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, bool], int] = {}
        for batch in batches:
            for dim, vectors, _ in _by_length(batch):
                home, guest = _placed(vectors, _pivots_of(dim, given), reach)
                for cell, n in enumerate(np.bincount(home)):
                    counts[dim, cell, True] = counts.get((dim, cell, True), 0) + int(n)
                for cell, n in enumerate(guest.sum(axis=0)):
                    counts[dim, cell, False] = counts.get((dim, cell, False), 0) + int(n)
        rows = [(*k, n) for k, n in counts.items() if n]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "cell", "home", "n"]
        )

    return run


def _dealt(given: dict[int, list[list[float]]], reach: float, blocks: dict[tuple, int]):
    """Send every vector to the tasks of its cells: pairs of blocks, the first one of homes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, vectors, part in _by_length(batch):
                home, guest = _placed(vectors, _pivots_of(dim, given), reach)
                spots = np.asarray(part.column(4))
                rows, tasks, sides = [], [], []
                for i, (cell, spot) in enumerate(zip(home.tolist(), spots.tolist())):
                    homes, guests = blocks[dim, cell, True], blocks.get((dim, cell, False), 0)
                    own = spot % homes
                    for b in range(homes):
                        tasks.append(f"{dim}/{cell}/{min(own, b)}h{max(own, b)}")
                        sides.append(0 if own <= b else 1)
                    for b in range(guests):
                        tasks.append(f"{dim}/{cell}/{own}g{b}")
                        sides.append(0)
                    rows += [i] * (homes + guests)
                for i, cell in zip(*np.nonzero(guest)):
                    cell = int(cell)
                    own = int(spots[i]) % blocks[dim, cell, False]
                    homes = blocks.get((dim, cell, True), 0)
                    tasks += [f"{dim}/{cell}/{a}g{own}" for a in range(homes)]
                    sides += [1] * homes
                    rows += [int(i)] * homes
                sent = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tasks, pa.string()),
                        pa.array(sides, pa.int32()),
                        sent.column(1),
                        sent.column(2),
                        sent.column(3),
                    ],
                    ["task", "side", "node", "copies", "vector"],
                )

    return run


def _linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of `a` and `b` have a cosine of `least` or more, decided in double precision."""
    linked = np.zeros((len(a), len(b)), bool)
    quick_a, quick_b = a.astype(np.float32), b.astype(np.float32).T
    doubt = 1e-5 + 3e-7 * a.shape[1]
    for i in range(0, len(a), _ROWS):
        near = quick_a[i : i + _ROWS] @ quick_b
        linked[i : i + _ROWS] = near >= least
        x, y = np.nonzero(np.abs(near - least) <= doubt)
        linked[i + x, y] = np.einsum("ij,ij->i", a[i + x], b[y]) >= least
    return linked


def _joined(least: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sides = np.asarray(group["side"])
        nodes, copies = np.asarray(group["node"]), np.asarray(group["copies"])
        vectors = _unit(_matrix(group["vector"].chunk(0)))
        first, second = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        task = group["task"][0].as_py().rpartition("/")[2]
        alone = "h" in task and len(set(task.split("h"))) == 1
        if alone:
            second = first
        links = np.zeros(len(group), np.int64)
        labels = nodes.copy()
        if len(first) and len(second):
            linked = _linked(vectors[first], vectors[second], least)
            if alone:
                np.fill_diagonal(linked, False)
            links[first] = linked @ copies[second]
            if not alone:
                links[second] += copies[first] @ linked
            rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            linked = linked[np.ix_(rows, cols)]
            first, second = first[rows], second[cols]
            none = np.iinfo(np.int64).max
            while len(first):
                before = labels[first].copy(), labels[second].copy()
                for i in range(0, len(first), _ROWS):
                    part = linked[i : i + _ROWS]
                    at = first[i : i + _ROWS]
                    least_b = np.where(part, labels[second], none).min(axis=1)
                    labels[at] = np.minimum(labels[at], least_b)
                    least_a = np.where(part, labels[at][:, None], none).min(axis=0)
                    labels[second] = np.minimum(labels[second], least_a)
                if all(np.array_equal(x, labels[y]) for x, y in zip(before, (first, second))):
                    break
        found = links > 0
        return pa.table({"node": nodes[found], "links": links[found], "root": labels[found]})

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
) -> DataFrame:
    """Groups of vectors that are linked by a cosine of `least` or more, exactly.

    Returns per row: the id, `n_links` (the other rows linked directly),
    `component_id` (the smallest id that links reach, its own included) and `kept`
    (is it that smallest one). Ids must be whole numbers.

    Equal vectors are one class and take part once, with their number. On the unit
    sphere the cosine is a distance, at most sqrt(2 - 2 * `least`) for a link.
    Every vector lives in the cell of its nearest pivot and visits those cells of
    a lower number that the triangle inequality does not rule out, so each pair
    meets once. Cells are joined on their own; a large one is dealt out in blocks.
    A block tells, per vector, how many links it has and the smallest vector of its
    part, never the pairs. PIVOTS vectors of the most frequent length come to the
    driver, and the number of vectors of every cell.

    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing; so do vectors of different lengths with each other, and rows
    without an id. They are kept, as their own component. Equal rows are links of
    each other, and `kept` is told by id, so all rows of the smallest id are kept.
    An empty table gives an empty result. Other columns are not looked at.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    id_type = vectors.schema[id_col].dataType.simpleString()
    sound = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn(
        "sound", F.coalesce(sound & F.col("id").isNotNull(), F.lit(False))
    )
    value_type = vectors.schema[vector_col].dataType.elementType.simpleString()
    classes = saved(
        rows.filter("sound")
        .groupBy("vector")
        .agg(F.min(F.col("id").cast("bigint")).alias("node"), F.count(F.lit(1)).alias("copies"))
        .select(
            F.size("vector").alias("dim"),
            "node",
            "copies",
            "vector",
            F.pmod(F.xxhash64("vector"), F.lit(2**31 - 1)).alias("spot"),
        ),
        "metric-classes",
    )
    common = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    given = {}
    if common is not None:
        chosen = classes.filter(F.col("dim") == common["dim"]).orderBy("spot", "node").limit(PIVOTS)
        raw = np.array([row["vector"] for row in chosen.select("vector").collect()])
        given = {common["dim"]: _unit(raw).tolist()}
    sizes = classes.mapInArrow(
        _counted(given, reach), "dim int, cell int, home boolean, n bigint"
    ).groupBy("dim", "cell", "home").agg(F.sum("n").alias("n"))
    blocks = {
        (row["dim"], row["cell"], row["home"]): -(-row["n"] // BLOCK) for row in sizes.collect()
    }
    dealt = classes.mapInArrow(
        _dealt(given, reach, blocks),
        f"task string, side int, node bigint, copies bigint, vector array<{value_type}>",
    )
    found = saved(
        dealt.groupBy("task").applyInArrow(
            _joined(least), "node bigint, links bigint, root bigint"
        ),
        "metric-links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(
        found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")),
        "metric-groups",
    )
    known = (
        classes.select("vector", "node", "copies")
        .join(links, "node", "left")
        .join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left")
        .select(
            F.col("vector").alias("v"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("root"),
        )
    )
    component = F.coalesce("root", F.col("id").cast("bigint")).cast(id_type)
    # Rows meet their class by hash, and then by value.
    return (
        rows.withColumn("h", F.when(F.col("sound"), F.xxhash64("vector")))
        .join(
            known.withColumn("k", F.xxhash64("v")),
            (F.col("h") == F.col("k")) & (F.col("vector") == F.col("v")),
            "left",
        )
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            component.alias("component_id"),
            F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
