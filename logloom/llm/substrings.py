"""Repeated passages: winnowed anchors, extension to whole windows, removal of what repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, fresh, gram_hashes, maybe_among, multipliers, row_key, saved

# Words of an anchor. A window of W words holds W - ANCHOR + 1 candidates, of
# which the one with the smallest hash is its anchor.
ANCHOR = 8
# Words of a window unless stated otherwise.
WINDOW = 35


def _window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of `window` words: its hash, the place and the hash of its anchor."""
    grams = gram_hashes(words, ANCHOR, multipliers(ANCHOR, 7))
    span = window - ANCHOR + 1
    # The last one among equals, looking from the right.
    views = np.lib.stride_tricks.sliding_window_view(grams, span)[:, ::-1]
    place = np.arange(len(views)) + span - 1 - views.argmin(axis=1)
    return gram_hashes(words, window, multipliers(window, 8)), place, grams[place]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, prints, found = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                counts.append(len(words))
                prints.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < window:
                    found.append(None)
                    continue
                _, place, anchor = _window_hashes(hashes.of(words), window)
                first = np.flatnonzero(np.diff(place, prepend=-1))
                found.append(anchor[first].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(prints, pa.string()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                ["key", "n_words", "print", "anchors"],
            )

    return run


def _extended(window: int):
    """Around the anchors that occur elsewhere, all windows that belong to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            seeds = batch.column(2).to_pylist()
            windows, starts = [], []
            for text, seed in zip(batch.column(1).cast(pa.binary()).to_pylist(), seeds):
                whole, _, anchor = _window_hashes(hashes.of(text.split()), window)
                at = np.flatnonzero(np.isin(anchor.view(np.int64), np.asarray(seed, np.int64)))
                windows.append(whole[at].view(np.int64))
                starts.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(windows, pa.list_(pa.int64())),
                    pa.array(starts, pa.list_(pa.int32())),
                    batch.column(3),
                ],
                ["key", "windows", "starts", "copies"],
            )

    return run


def _merged(window: int):
    """Windows from their starts to the ranges of words that they cover: first word, end, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = []
            for starts in batch.column(1).to_pylist():
                at = np.sort(np.asarray(starts, np.int64))
                apart = np.flatnonzero(np.diff(at) > window)
                first = at[np.concatenate(([0], apart + 1))]
                end = at[np.concatenate((apart, [len(at) - 1]))] + window
                ranges.append(np.stack([first, end], axis=1).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ranges, pa.list_(pa.int64()))], ["key", "ranges"]
            )

    return run


def _kept(text: bytes, ranges: list[int]) -> tuple[int, bytes]:
    """How many words of `text` lie in the `ranges`, and the others joined by one space."""
    words = text.split()
    kept, at = [], 0
    for first, end in zip(ranges[::2], ranges[1::2]):
        kept += words[at:first]
        at = end
    kept += words[at:]
    return len(words) - len(kept), b" ".join(kept)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, texts, prints = [], [], []
        ranges = batch.column(2).to_pylist()
        for text, gone in zip(batch.column(1).cast(pa.binary()).to_pylist(), ranges):
            n, kept = _kept(text, gone)
            removed.append(n)
            prints.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(removed, pa.int64()),
                pa.array(prints, pa.string()),
                pa.array(texts, pa.string()),
            ],
            ["key", "n_removed", "kept_sha256", "kept_text"],
        )


def _cut_texts(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """The texts without the words in their ranges. Those without ranges stay as they are."""
    cut = [
        text if gone is None else _kept(text, gone)[1]
        for text, gone in zip(texts.cast(pa.binary()).to_pylist(), ranges.to_pylist())
    ]
    return pa.array([None if t is None else t.decode("utf-8", "replace") for t in cut], pa.string())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def _repeats(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What repeats among `rows` (`key`, `text`).

    Per row its `key`, `n_words` and `print`; the prints of texts that have copies (`print`),
    which repeat from end to end; and the `ranges` of words that repeat of others (`key`).
    """
    key_type = rows.schema["key"].dataType.simpleString()
    scanned = saved(
        rows.mapInArrow(
            _anchors(window), f"key {key_type}, n_words bigint, print string, anchors array<bigint>"
        ),
        "repeats-scanned",
    )
    # One member of every class takes part. Anchors depend on the words alone, and those of
    # texts that surely have no copy stay where they are.
    long = scanned.filter("anchors IS NOT NULL")
    classes = long.groupBy("print").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copied = saved(classes.select("print"), "repeats-copied")
    told = maybe_among(long.select("key", "print", "anchors"), "print", copied, "print")
    folded = (
        told.filter("maybe")
        .groupBy("print")
        .agg(
            F.min("key").alias("key"),
            F.count(F.lit(1)).alias("copies"),
            F.first("anchors").alias("anchors"),
        )
    )
    single = told.filter("NOT maybe").withColumn("copies", F.lit(1).cast("bigint"))
    chosen = single.select("key", "copies", "anchors").unionByName(folded.drop("print"))
    spread = chosen.select("key", "copies", F.explode("anchors").alias("anchor"))
    seeds = saved(
        spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"),
        "repeats-seeds",
    )
    seeded = saved(
        maybe_among(spread, "anchor", seeds, "anchor")
        .filter("maybe")
        .join(seeds, "anchor")
        .groupBy("key", "copies")
        .agg(F.collect_set("anchor").alias("seeds")),
        "repeats-seeded",
    )
    extended = saved(
        maybe_among(rows, "key", seeded, "key")
        .filter("maybe")
        .join(seeded, "key")
        .select("key", "text", "seeds", "copies")
        .mapInArrow(
            _extended(window),
            f"key {key_type}, windows array<bigint>, starts array<int>, copies bigint",
        ),
        "repeats-extended",
    )
    windows = extended.select(
        "key", "copies", F.explode(F.arrays_zip("windows", "starts")).alias("w")
    ).select("key", "copies", F.col("w.windows").alias("hash"), F.col("w.starts").alias("start"))
    repeated = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Texts that have copies repeat from end to end, whatever their windows say.
    starts = (
        windows.filter("copies = 1")
        .join(repeated.select("hash"), "hash")
        .groupBy("key")
        .agg(F.collect_list("start").alias("starts"))
    )
    ranges = starts.mapInArrow(_merged(window), f"key {key_type}, ranges array<bigint>")
    return scanned, copied, saved(ranges, "repeats-ranges")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Remove every word that lies in a passage of `window` or more words found elsewhere.

    Words are runs of anything but ASCII white space. A window is `window`
    consecutive words of one document; it repeats if its word sequence also
    starts at any other place, of another document or of the same one. All
    windows are judged on the input. Returns per row: the id, `n_words`,
    `n_removed`, `kept_sha256` (of the kept words joined by one space) and
    `kept_text`, which is null where nothing was removed.

    Every window has one anchor, the run of `ANCHOR` words in it with the
    smallest hash; equal windows have equal anchors. Only anchors that occur
    twice or more are seeds; around them the matches are extended to all the
    windows of the anchor, and the windows that occur twice or more are repeats.
    Their union is the maximal repeats. No pairs of occurrences are made, so a
    passage in very many documents costs its occurrences. Documents with the same
    words are one class: its first member stands for the others, which repeat
    from end to end.

    Null and empty texts have no words. Rows with the same id and text are copies
    of each other, like any others. An empty table gives an empty result. Other
    columns are not looked at.
    """
    if window <= ANCHOR:
        raise ValueError(f"window must be more than {ANCHOR} words, got {window}")
    rows = _keyed(docs, id_col, text_col)
    scanned, copied, ranges = _repeats(rows, window)
    cut = (
        maybe_among(rows, "key", ranges, "key")
        .filter("maybe")
        .select("key", "text")
        .join(ranges, "key")
        .mapInArrow(
            _cut,
            f"key {rows.schema['key'].dataType.simpleString()}, n_removed bigint, "
            "kept_sha256 string, kept_text string",
        )
    )
    nothing = hashlib.sha256(b"").hexdigest()
    copied_all = F.coalesce("copied", F.lit(False))
    return (
        scanned.select("key", "n_words", "print")
        .join(copied.withColumn("copied", F.lit(True)), "print", "left")
        .join(cut, "key", "left")
        .select(
            "key",
            F.col("key.id").alias(id_col),
            "n_words",
            F.when(copied_all, F.col("n_words"))
            .otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint")))
            .alias("n_removed"),
            F.when(copied_all, F.lit(nothing))
            .otherwise(F.coalesce("kept_sha256", "print"))
            .alias("kept_sha256"),
            F.when(copied_all, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        )
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with repeated passages cut out of the texts. Untouched texts stay as they are.

    Texts that a map of the changed rows rules out are not shuffled.
    """
    own = fresh(docs, "row_key")
    scanned, copied, ranges = _repeats(_keyed(docs, id_col, text_col), WINDOW)
    whole = scanned.join(copied, "print").select(
        "key", F.array(F.lit(0).cast("bigint"), "n_words").alias("ranges")
    )
    # Rows with the same id and text have one key.
    changed = saved(
        ranges.unionByName(whole.dropDuplicates(["key"])).select(
            F.col("key").alias(f"{own}_cut"), F.col("ranges").alias(f"{own}_ranges")
        ),
        "repeats-changed",
    )
    names = {c: f"{own}_{k}" for k, c in enumerate(docs.columns)}
    keyed = docs.withColumn(own, row_key(id_col, F.col(text_col))).withColumnsRenamed(names)
    told = maybe_among(keyed, own, changed, f"{own}_cut")
    back = [F.col(own).alias(c) for c, own in names.items()]
    same = told.filter("NOT maybe").select(back)
    joined = told.filter("maybe").join(changed, F.col(own) == F.col(f"{own}_cut"), "left")
    cut_text = F.arrow_udf(_cut_texts, "string")
    text = names[text_col]
    return same.unionByName(
        joined.withColumn(text, cut_text(text, f"{own}_ranges")).select(back)
    )
