"""Encoded records to files of newline-delimited JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import check_range, names


def _packed(max_bytes: int, max_records: int | None):
    """Give every record of a task the file it goes to: a new one where the next would not fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        file = size = records = place = 0
        for batch in batches:
            files = []
            for length in pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist():
                # A line feed ends every record.
                if records and (size + length + 1 > max_bytes or records == max_records):
                    file, size, records = file + 1, 0, 0
                size, records = size + length + 1, records + 1
                files.append(f"{task:08d}-{file:08d}")
            places = pa.array(range(place, place + len(files)), pa.int64())
            place += len(files)
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), places, batch.column(0)], ["file", "place", "record"]
            )

    return run


# Sent to the executors whole, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_packed"]))


def write_ndjson(
    records: DataFrame,
    directory: str,
    order_cols: str | Sequence[str] | None = None,
    max_records_per_file: int | None = None,
    json_col: str = "json",
    mode: str = "errorifexists",
    compression: str | None = None,
    max_bytes_per_file: int | None = None,
    encode: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write `json_col` as text files, one record per line.

    With `order_cols` the records are in that order within the files and from
    file to file. Ranges of the order are written side by side, so the columns
    should identify a record (a hot stream alone would be one range). Without
    `order_cols` the partitions are written as they are, with no shuffle. A new
    file starts after `max_records_per_file` records.

    With `max_bytes_per_file` a new file starts before a record that would take its
    file over that size, line feeds included, before compression. So no file is larger,
    unless a single record is. Each file is then in a folder `file=...` of its own;
    the folders sort in the order of the records. A running total over the rows of a task
    decides, and no row is shuffled for it.

    Nothing is written but the files. The ranges are found by a first look at `records`, so
    these are computed twice. To keep that cheap, give the rows as they are before they are
    encoded, and `encode`, which makes `json_col` of them once they are in order.
    """
    if order_cols is not None:
        order = names(order_cols)
        records = records.repartitionByRange(*order).sortWithinPartitions(*order)
    if encode is not None:
        records = encode(records)
    if max_records_per_file is not None:
        check_range("max_records_per_file", max_records_per_file, 1)
    lines = records.select(json_col)
    if max_bytes_per_file is not None:
        check_range("max_bytes_per_file", max_bytes_per_file, 1)
        # As bytes, which need not be UTF-8.
        lines = (
            lines.select(F.col(json_col).cast("binary"))
            .mapInArrow(
                _packed(max_bytes_per_file, max_records_per_file),
                "file string, place bigint, record binary",
            )
            .sortWithinPartitions("file", "place")
            .select("file", F.col("record").cast("string").alias(json_col))
        )
    writer = lines.write.mode(mode).option("lineSep", "\n")
    if max_bytes_per_file is not None:
        writer = writer.partitionBy("file")
    elif max_records_per_file is not None:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if compression is not None:
        writer = writer.option("compression", compression)
    writer.text(directory)
