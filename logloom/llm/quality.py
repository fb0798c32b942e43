"""Document quality: positive-unlabelled learning over shape features of whole texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, saved

# Every fifth document by this hash is held out; its label is never read.
FOLDS = 5
STEPS = 12
RIDGE = 1e-3

_SYMBOLS = "!#$%&*+/<=>@\\^_`{|}~"
_TAIL = re.compile(r"[^\w\s]{2}(?!\S)")
FEATURES = 23


def held_out(id_col: str):
    """True for the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def shape(text: str) -> list[float]:
    """Shape of a text in `FEATURES` numbers near 0 to 1, from all of it. No word is named."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * (FEATURES - 1) + [1.0]
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = text.split("\n")
    distinct = len(counts)
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        min(math.log1p(n) / 8, 1.5),
        min(sizes.mean() / 10, 2.0),
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        min(len(_TAIL.findall(text)) / n, 1.0),
        min(8 * sum(map(text.count, _SYMBOLS)) / chars, 1.0),
        min(text.count("|") / n, 1.0),
        min(text.count("!") / n, 1.0),
        (len(lines) - len(set(lines))) / len(lines),
        same / n,
        max(counts.values()) / n,
        math.log1p(distinct) / math.log1p(n),
        distinct / n,
        min(8 * sum(map(text.count, "0123456789")) / chars, 1.0),
        min(text.count(".") / n, 1.0),
        min(text.count(",") / n, 1.0),
        np.count_nonzero(sizes > 12) / n,
        np.count_nonzero(sizes <= 3) / n,
        min(n / len(lines) / 100, 1.0),
        1.0 if n < 5 else 0.0,
        min(math.log1p(len(lines)) / 5, 1.0),
        0.0,
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """Features, their squares, square roots, and 1: what the linear model sees."""
    return np.concatenate([x, x * x, np.sqrt(x), np.ones((len(x), 1))], axis=1)


WIDTH = 3 * FEATURES + 1


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [shape(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"]
        )


def _sums(weights: list[float] | None):
    """Per partition, the sums that a step needs: of the positives, and of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = None if weights is None else np.asarray(weights)
        total = np.zeros(WIDTH * WIDTH + 2 * WIDTH + 6)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, FEATURES)
            x, positive = expanded(x), np.asarray(batch.column(1)).astype(bool)
            z = x @ w if w is not None else np.zeros(len(x))
            s = logistic(z)
            loss = np.logaddexp(0, z)
            hessian = (x * (s * (1 - s))[:, None]).T @ x
            total += np.concatenate(
                [
                    hessian.ravel(),
                    x.T @ s,
                    x[positive].sum(axis=0),
                    [len(x), positive.sum(), loss.sum(), loss[positive].sum(), 0.0, 0.0],
                ]
            )
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], ["at", "value"]
        )

    return run


def _gather(rows: DataFrame, weights: list[float] | None) -> np.ndarray:
    """The sums of all partitions, added up on the executors; a fixed number of values."""
    parts = rows.mapInArrow(_sums(weights), "at bigint, value double")
    total = np.zeros(WIDTH * WIDTH + 2 * WIDTH + 6)
    for at, value in parts.groupBy("at").agg(F.sum("value")).collect():
        total[at] = value
    return total


def learn(rows: DataFrame, prior: float) -> list[float]:
    """Weights that minimise the non-negative unbiased risk over `rows` (`x`, `positive`).

    All rows serve as the unlabelled sample, so that it has the class prior.

    With the logistic loss the unbiased risk of positives P and unlabelled U,
    `prior` * E_P[l(z)] + E_U[l(-z)] - `prior` * E_P[l(-z)], is convex: its first
    and last terms add up to -`prior` * E_P[z]. Newton's method takes one pass
    over all rows per step. Where the share of negatives in the risk,
    E_U[l(-z)] - `prior` * E_P[l(-z)], falls below zero, the model fits single
    positives; the step is then halved until it does not.
    """
    weights = [0.0] * WIDTH
    previous, step = None, None
    for _ in range(STEPS):
        total = _gather(rows, weights)
        hessian = total[: WIDTH * WIDTH].reshape(WIDTH, WIDTH)
        scores, positives = total[WIDTH * WIDTH : -6].reshape(2, WIDTH)
        n_u, n_p, loss_u, loss_p = total[-6:-2]
        if not n_u or not n_p:
            return weights
        negative_risk = loss_u / n_u - prior * loss_p / n_p
        if negative_risk < 0 and previous is not None:
            step = step / 2
            if np.abs(step).max() < 1e-4:
                return previous
            weights = [float(v) for v in np.asarray(previous) + step]
            continue
        w = np.asarray(weights)
        ridge = np.full(WIDTH, RIDGE)
        ridge[-1] = 0.0
        gradient = scores / n_u - prior * positives / n_p + ridge * w
        step = -np.linalg.lstsq(hessian / n_u + np.diag(ridge + 1e-9), gradient, rcond=None)[0]
        size = np.abs(step).max()
        step = step * min(1.0, 8.0 / size) if size else step
        previous = weights
        weights = [float(v) for v in w + step]
        if size < 1e-3:
            break
    return weights


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
) -> DataFrame:
    """Quality of every whole text: the id, `held_out`, `score` and `predicted`.

    Trusted positives are the labelled documents of quality 1; all documents, with
    their labels left aside, are the unlabelled text. Documents whose hash holds them out take part in neither, and
    their labels are not read. The class prior is the share of quality 1 among
    the labels read, smoothed towards one half. The score is a logistic model of
    the text's shape alone, learned from all rows that take part.

    Null and empty texts are scored like any text, as ones without words. Where no
    positives or no unlabelled rows are left, all scores are 0.5. A document with
    contradicting labels counts with the larger one; null labels are not read.
    Repeated rows get the same score. Other columns are not looked at. Texts are
    read once: their shapes, some twenty numbers each, are kept in a table.
    """
    weights, shapes = fitted(docs, labels, id_col, text_col, label_col)
    given = np.asarray(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(logistic(expanded(x) @ given), pa.float64())],
                ["id", "score"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    judged = shapes.select("id", "x").mapInArrow(run, f"id {id_type}, score double")
    return judged.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fitted(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str
) -> tuple[list[float], DataFrame]:
    """The weights, and the table of ids and shapes that they were learned from."""
    known = (
        labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label"))
        .filter(F.col("label").isNotNull() & F.col("label_id").isNotNull() & ~held_out("label_id"))
        .groupBy("label_id")
        .agg(F.max("label").alias("label"))
    )
    n_good, n_known = known.agg(
        F.coalesce(F.sum((F.col("label") == 1).cast("bigint")), F.lit(0)), F.count(F.lit(1))
    ).first()
    prior = (n_good + 1) / (n_known + 2)
    id_type = docs.schema[id_col].dataType.simpleString()
    shapes = saved(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            _shapes, f"id {id_type}, x array<double>"
        ),
        "quality-shapes",
    )
    trusted = known.filter("label = 1").select("label_id", F.lit(True).alias("positive"))
    rows = (
        shapes.filter(~held_out("id"))
        .join(trusted, F.col("id") == F.col("label_id"), "left")
        .select("x", F.coalesce("positive", F.lit(False)).alias("positive"))
    )
    return learn(saved(rows, "quality-rows"), prior), shapes


def scored(
    docs: DataFrame, weights: list[float], text_col: str = "text"
) -> DataFrame:
    """`docs` with their scores by given weights, in one more column, its last. No shuffle."""
    name = fresh(docs, "score")
    given = np.asarray(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            x = np.array([shape(t or "") for t in texts]).reshape(len(texts), FEATURES)
            score = pa.array(logistic(expanded(x) @ given), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, score], [*batch.schema.names, name]
            )

    types = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, types)


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
) -> DataFrame:
    """`docs` without those that the classifier rejects."""
    weights, _ = fitted(docs, labels, id_col, text_col, label_col)
    judged = scored(docs, weights, text_col)
    return judged.filter(F.col(judged.columns[-1]) >= threshold).select(*docs.columns)
