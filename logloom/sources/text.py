"""Text files as rows of lines, in batch and as an unbounded stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..limits import check_range
from ..session import settled

# Parts of files up to which their line counts are sent to every task: some 100 MB.
MAX_SENT_PARTS = 500_000


def check_delimiter(delimiter: str) -> str:
    if len(delimiter.encode()) != 1:
        raise ValueError(f"delimiter must be a single byte, got {delimiter!r}")
    return delimiter


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = "\n",
    with_places: bool = False,
    per_folder: bool = False,
) -> DataFrame:
    """One row per line in column `value`.

    Only the delimiter separates lines; without it Spark would also split on CR.
    `with_places` adds the `path` of the file and `line_no`, the number of the line in it
    from 0, so that the order of the source can be restored. A large file is read in
    parts by many tasks: a first job counts the lines of every part, the counts of
    the parts ahead are added up per file, and the lines are numbered where they are
    read. They are not shuffled, unless there are too many parts to send around. With
    `per_folder` the numbers go on from file to file of a folder, in the order of their names.
    """
    lines = spark.read.option("lineSep", check_delimiter(delimiter)).text(path)
    if not with_places:
        return lines
    placed = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        # Lines of a part are consecutive in the task that reads it.
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    whole = F.regexp_replace("path", "[^/]*$", "") if per_folder else F.col("path")
    ahead = (
        Window.partitionBy(whole).orderBy("path", "start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = settled(
        placed.groupBy("path", "start")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .drop("n"),
        "file-parts",
    )
    if parts.count() <= MAX_SENT_PARTS:
        parts = F.broadcast(parts)
    number = F.col("ahead") + F.col("place") - F.col("first")
    return placed.join(parts, ["path", "start"]).select("path", number.alias("line_no"), "value")


def stream_lines(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    max_bytes: int | str | None = None,
    delimiter: str = "\n",
) -> DataFrame:
    """Unbounded source of lines in column `value`, with lossless bounded intake.

    A micro-batch takes at most `max_files` files or `max_bytes` bytes. What is
    beyond waits at the source, and nothing is dropped. Start the query with
    `trigger(availableNow=True)` to stop after the end of the present input.
    """
    if max_files is not None and max_bytes is not None:
        raise ValueError("give max_files or max_bytes, not both")
    reader = spark.readStream.option("lineSep", check_delimiter(delimiter))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", check_range("max_files", max_files, 1))
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.text(path)
