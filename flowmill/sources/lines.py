"""Lines of text files with their number, and the record they belong to.

A text file has no keys: what a line means hangs on its place, which no task knows that reads
a piece of the file. Each piece (a file split, of bounded size) is scanned once in its own order,
counting its lines and separator lines; the counts of the pieces, a few numbers each, are
scanned in two levels, and every line adds its piece's offset to its own count. So files of any
length, and records of any length, are numbered without a task that sees them whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.ranking import running_before
from flowmill.session import save_and_reload

_SCANNED = "path string, start bigint, at bigint, mark bigint, since bigint, value string"


def _scan(mark: str | None):
    """Per line: its number in the piece, the separator lines up to it, and the lines since the last of them.

    Before a piece's first separator ``since`` counts from the piece's begin. Rows of a piece arrive
    in a row and in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, at, marks, since = None, 0, 0, 0
        for batch in batches:
            trimmed = pc.utf8_trim_whitespace(batch.column("value"))
            is_mark = np.zeros(len(trimmed), dtype=bool) if mark is None else np.asarray(pc.equal(trimmed, mark))
            value = batch.column("value") if mark is None else trimmed
            paths, starts = batch.column("path"), batch.column("start").to_numpy()
            codes = paths.dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])]))
            numbers = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(starts)]):
                here = (paths[a].as_py(), int(starts[a]))
                if here != piece:
                    piece, at, marks, since = here, 0, 0, 0
                found = is_mark[a:b]
                places = np.arange(b - a)
                last = np.maximum.accumulate(np.where(found, places, -1))
                counted = marks + np.cumsum(found)
                gone = np.where(last >= 0, places - last, since + places)
                numbers.append((at + places, counted, gone))
                at, marks, since = at + b - a, int(counted[-1]), int(gone[-1]) + 1
            at_all, mark_all, since_all = (pa.array(np.concatenate(x), pa.int64()) for x in zip(*numbers))
            yield pa.record_batch([paths, batch.column("start"), at_all, mark_all, since_all, value],
                                  names=["path", "start", "at", "mark", "since", "value"])

    return run


def _pieces(spark: SparkSession, path: str, mark: str | None) -> DataFrame:
    """The scanned lines, a stored table: what the pieces are is settled once."""
    text = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    return save_and_reload(text.mapInArrow(_scan(mark), _SCANNED), "lines")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): all lines of the files under ``path``, in the order of the files' names, numbered from 0."""
    lines = _pieces(spark, path, None)
    sizes = lines.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))
    before = running_before(sizes, ["path", "start"], {"before": "n"}).select("path", "start", "before")
    return lines.join(before, ["path", "start"]).select((F.col("before") + F.col("at")).alias("line"), "value")


def record_lines(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(record, at, value): the lines of records that are opened by a line ``mark``.

    record is the ordinal of the separator line over all files, in the order of their names, and at
    the line's place after it: 0 for the separator itself, which is a row too. Lines are trimmed of white space on both
    sides, so a separator may be padded or end in CRLF; ``mark`` inside a line opens nothing. Lines before
    the first separator belong to no record and are left out.
    """
    lines = _pieces(spark, path, mark)
    pieces = lines.groupBy("path", "start").agg(
        F.count(F.lit(1)).alias("n"), F.max("mark").alias("marks"), F.max_by("since", "at").alias("tail"))
    # Where the record that is open at the begin of a piece was opened, as a line number over all files.
    opened = F.when(F.col("marks") > 0, F.col("before") + F.col("n") - 1 - F.col("tail"))
    pieces = running_before(pieces, ["path", "start"], {"before": "n", "records": "marks"}, {"last": opened})
    rows = lines.join(pieces.select("path", "start", "before", "records", "last"), ["path", "start"])
    place = F.when(F.col("mark") > 0, F.col("since")).otherwise(F.col("before") - F.col("last") + F.col("since"))
    rows = rows.select((F.col("records") + F.col("mark") - 1).alias("record"), place.alias("at"), "value")
    return rows.filter("record >= 0")
