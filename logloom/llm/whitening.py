"""Whitening of vectors by principal components from contour integrals of the covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

# Fixed values of the contract: an entry c is read as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components given where the caller does not say how many.
COMPONENTS = 8
# Points of the quadrature on the upper half of a contour.
POINTS = 8
# Eigenvalues per contour, unless they lie too close together to be told apart.
PER_CONTOUR = 4
# Rounds of projection after which a contour counts as failed.
ROUNDS = 40
# Residual of an eigenvector, relative to the norm of the matrix.
RESIDUAL = 2e-14


def _entries(column: pa.Array) -> np.ndarray:
    """The whole numbers that stand for a batch of vectors, one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(SCALE * flat) + OFFSET
    if len(scaled) and np.abs(scaled).max() >= 2**52:
        raise OverflowError("a vector has an entry too large for exact whole numbers")
    return scaled.astype(np.int64).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per dimension and task: how many vectors, and the exact sum of their entries."""
    n, total = 0, None
    for batch in batches:
        x = _entries(batch.column(0))
        if not len(x):
            continue
        n += len(x)
        # Python numbers, so that no sum wraps.
        part = x.astype(object).sum(axis=0) if np.abs(x).max() > 2**40 else x.sum(axis=0)
        total = part.astype(object) if total is None else total + part
    if n:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(total)), pa.int32()),
                pa.array([n] * len(total), pa.int64()),
                pa.array([str(s) for s in total], pa.string()),
            ],
            ["i", "n", "s"],
        )


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: whole numbers of 64 bits where they hold it, else of any size."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + int(np.abs(sums).max(initial=0)) < 2**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _deviations(u: np.ndarray) -> list[int]:
    if u.dtype == object or np.abs(u).max(initial=0).astype(float) ** 2 * u.shape[1] >= 2**62:
        squares = (u.astype(object) ** 2).sum(axis=1).tolist()
        if max(squares, default=0) >= 2**63:
            raise OverflowError("a deviation does not fit in a long")
        return squares
    return (u * u).sum(axis=1).tolist()


def _products(n: int, sums: np.ndarray):
    """One row per matrix row and task: its part of the products of centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), len(sums)))
        for batch in batches:
            z = _centred(_entries(batch.column(0)), n, sums).astype(np.float64) / n
            total += z.T @ z
        rows = [total[i, i:].tolist() for i in range(len(total))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
            ["i", "row"],
        )

    return run


def covariance(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance (divisor `n`) of the column `v` of `vectors`, centred before multiplying.

    Every task gives the upper triangle of its own products once, so what is
    shuffled and added up depends on the tasks and not on the rows.
    """
    d = len(sums)
    parts = vectors.select("v").mapInArrow(_products(n, sums), "i int, row array<double>")
    cells = (
        parts.select("i", F.posexplode("row").alias("j", "part"))
        .groupBy("i", "j")
        .agg(F.sum("part").alias("total"))
        .collect()
    )
    matrix = np.zeros((d, d))
    for cell in cells:
        matrix[cell["i"], cell["i"] + cell["j"]] = cell["total"] / n
    return np.triu(matrix) + np.triu(matrix, 1).T


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed `shift`, by its inertia.

    Symmetric elimination of the shifted matrix with pivots of one or two rows: the
    signs of the pivots are those of the eigenvalues.
    """
    a = matrix - shift * np.eye(len(matrix))
    ratio = (1 + np.sqrt(17)) / 8
    count = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        rest = np.abs(np.triu(a, 1))
        q = np.unravel_index(int(rest.argmax()), rest.shape)
        if diagonal[p] >= ratio * rest[q]:
            if a[p, p] == 0:
                return count  # What is left is zero, and not above the shift.
            count += a[p, p] > 0
            keep = np.delete(np.arange(len(a)), p)
            a = a[np.ix_(keep, keep)] - np.outer(a[keep, p], a[p, keep]) / a[p, p]
        else:
            # Such a block has one positive and one negative eigenvalue.
            count += 1
            block = np.array(q)
            keep = np.delete(np.arange(len(a)), block)
            inner = np.linalg.inv(a[np.ix_(block, block)])
            a = a[np.ix_(keep, keep)] - a[np.ix_(keep, block)] @ inner @ a[np.ix_(block, keep)]
        a = (a + a.T) / 2
    return int(count)


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals with the `wanted` largest eigenvalues, and how many each one holds.

    The last one may hold more. Eigenvalues that are nothing but rounding are left out.
    """
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)
    floor = top * len(matrix) * 1e-15
    wanted = min(wanted, above(matrix, floor)) if top > 0 else 0
    if not wanted:
        return []
    low, high = floor, top
    # The highest bound with all that are wanted above it, to a part of the whole.
    while high - low > 1e-3 * high:
        middle = (low + high) / 2
        if above(matrix, middle) >= wanted:
            low = middle
        else:
            high = middle
    # Bounds, and how many eigenvalues exceed each of the two.
    found, open_ = [], [(low, top, above(matrix, low), 0)]
    while open_:
        a, b, over_a, over_b = open_.pop()
        if over_a - over_b <= PER_CONTOUR or b - a < 1e-9 * top:
            if over_a > over_b:
                found.append((a, b, over_a - over_b))
            continue
        middle = (a + b) / 2
        over = above(matrix, middle)
        open_ += [(a, middle, over_a, over), (middle, b, over, over_b)]
    return sorted(found, reverse=True)


def _projected(matrix: np.ndarray, spaces: dict[int, np.ndarray]):
    """Solve the shifted systems of quadrature points; the part of the projection of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                turn = np.exp(1j * row["angle"])
                shift = row["centre"] + row["radius"] * turn
                space = spaces[row["contour"]]
                solved = np.linalg.solve(shift * np.eye(len(matrix)) - matrix, space)
                part = row["weight"] / 2 * (row["radius"] * turn * solved).real
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["contour"]], pa.int32()),
                        pa.array([row["point"]], pa.int32()),
                        pa.array([part.ravel().tolist()], pa.list_(pa.float64())),
                    ],
                    ["contour", "point", "part"],
                )

    return run


def _ritz(matrix: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of `matrix` within the span of `space`."""
    basis, _ = np.linalg.qr(space)
    basis, _ = np.linalg.qr(basis)
    inner = basis.T @ matrix @ basis
    values, turns = np.linalg.eigh((inner + inner.T) / 2)
    return values, basis @ turns


def largest(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a covariance, falling, and their vectors as columns.

    Inertia counts find intervals with few eigenvalues each. Every contour around
    an interval is a quadrature of shifted solves, which Spark runs side by side;
    they project a random space onto the eigenvalues inside, Rayleigh-Ritz takes the
    vectors out of it, and rounds go on until their residuals are rounding. A contour is
    done when it has as many as the inertia says, so none is missed. Fewer come
    back where the matrix has fewer eigenvalues above rounding.
    """
    size = float(np.abs(matrix).sum(axis=1).max()) if len(matrix) else 0.0
    if not size > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    unit = matrix / size
    parts = intervals(unit, wanted)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    random = np.random.default_rng(3)
    spaces = {
        k: random.normal(size=(len(unit), min(len(unit), 2 * count + 4)))
        for k, (_, _, count) in enumerate(parts)
    }
    found: dict[int, np.ndarray] = {}
    for _ in range(ROUNDS):
        if not spaces:
            break
        rows = [
            (k, p, (a + b) / 2, (b - a) / 2, float(np.pi / 2 * (1 - nodes[p])), float(weights[p]))
            for k, (a, b, _) in enumerate(parts)
            if k in spaces
            for p in range(POINTS)
        ]
        points = spark.createDataFrame(
            rows, "contour int, point int, centre double, radius double, angle double, weight double"
        )
        solved = points.mapInArrow(
            _projected(unit, spaces), "contour int, point int, part array<double>"
        ).collect()
        solved.sort(key=lambda row: (row["contour"], row["point"]))
        for k in list(spaces):
            a, b, count = parts[k]
            shape = spaces[k].shape
            total = sum(np.reshape(row["part"], shape) for row in solved if row["contour"] == k)
            values, vectors = _ritz(unit, total)
            inside = (values > a) & (values <= b)
            residual = np.abs(unit @ vectors[:, inside] - vectors[:, inside] * values[inside])
            if inside.sum() == count and residual.max(initial=0) <= RESIDUAL:
                found[k] = vectors[:, inside]
                del spaces[k]
            else:
                spaces[k] = vectors
    if spaces:
        raise ArithmeticError("a contour gave other eigenvalues than its inertia count")
    if not found:
        return np.zeros(0), np.zeros((len(matrix), 0))
    # All together once more, which makes vectors of different contours orthogonal.
    values, vectors = _ritz(unit, np.hstack([found[k] for k in sorted(found)]))
    order = np.argsort(values)[::-1][:wanted]
    vectors = vectors[:, order]
    # Of the two signs, the one whose largest entry is positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order] * size, vectors * signs


def _whitened(n: int, sums: np.ndarray, projection: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _centred(_entries(batch.column(1)), n, sums)
            rows = (u.astype(np.float64) / n) @ projection
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(_deviations(u), pa.int64()),
                    pa.array(rows.tolist(), pa.list_(pa.float64())),
                ],
                ["id", "deviation", "w"],
            )

    return run


def whitened_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """Whitened principal components of vectors, one row per vector and component.

    Entries c are read as the whole numbers floor(1024 c) + 100000. Returns the id,
    `component` (from 1, by falling eigenvalue), `n` (vectors), `deviation` (the
    sum of squares of n x - S over the dimensions, exact), `whitened` (the centred vector
    projected on the component, over the root of its eigenvalue), `explained` (the
    eigenvalue's share of the trace) and `identity_error` (the largest entry of the
    covariance of all that is whitened, less the identity).

    Three jobs over the vectors: exact sums, products of centred vectors, and the
    projection. The components come from `largest`. What reaches the driver is a
    matrix of dimensions squared, however many vectors there are.

    Vectors that are null, or hold a null or a number that is not finite, are left
    out; so is nothing else: rows without an id, and rows that repeat, take part like all
    others. An empty table, and vectors that are all equal, have no components and give
    no rows; where vectors span fewer dimensions than `components`, only those
    are given. Vectors of different lengths are an error, as are entries of 2^42
    or more. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(
        "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(
        F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))
    )
    sizes = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError("vectors have different lengths")
    counted = []
    if sizes["most"]:
        counted = (
            rows.select("v")
            .mapInArrow(_sums, "i int, n bigint, s string")
            .groupBy("i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            .orderBy("i")
            .collect()
        )
    n = counted[0]["n"] if counted else 0
    sums = np.array([int(row["s"]) for row in counted], dtype=object)
    matrix = covariance(rows, n, sums) if n else np.zeros((0, 0))
    values, found = largest(spark, matrix, components)
    k = len(values)
    projected = saved(
        rows.limit(0).select("id", F.lit(0).cast("bigint").alias("deviation"), F.col("v").alias("w"))
        if not k
        else rows.mapInArrow(
            _whitened(n, sums, found / np.sqrt(values)),
            f"id {id_type}, deviation bigint, w array<double>",
        ),
        "whitened",
    )
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    error = 0.0
    if pairs:
        entries = projected.agg(
            *[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]
        ).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(entries, pairs))
    explained = F.array(*[F.lit(float(e / np.trace(matrix))) for e in values]).cast("array<double>")
    return (
        projected.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
        .select(
            F.col("id").alias(id_col),
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(n).cast("bigint").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, F.col("at")).alias("explained"),
            F.lit(float(error)).alias("identity_error"),
        )
    )
