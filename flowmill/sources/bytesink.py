"""Write rows of (file, head, data) as files: a head, then the data of all its rows.

Spark's own writers end every row with a separator and choose file names
themselves; capture export needs exact bytes under given names, and a corpus
record may be longer than one row can be. Rows are streamed, so a file of any
length needs constant memory.

The frame must hold each file's rows in one partition and in order, see
:func:`write_files`. Every file is written under a temporary name and renamed
when its task ends, so a retried or speculative task leaves one whole file.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from flowmill.sources.files import resolve


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator):
        filesystem, root = resolve(self.root)
        tag = uuid.uuid4().hex
        current, out, done = None, None, []
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("file", "head", "data")]
            for name, head, data in zip(*columns):
                name = name.as_py()
                if name != current:
                    if out is not None:
                        out.close()
                    target = posixpath.join(root, name)
                    filesystem.create_dir(posixpath.dirname(target), recursive=True)
                    part = posixpath.join(
                        posixpath.dirname(target), f"_{posixpath.basename(target)}.{tag}"
                    )
                    out = filesystem.open_output_stream(part)
                    done.append((part, target))
                    current = name
                    out.write(head.as_buffer())
                out.write(data.as_buffer())
        if out is not None:
            out.close()
        for part, target in done:
            filesystem.move(part, target)
        return WriterCommitMessage()


class ByteFiles(DataSource):
    @classmethod
    def name(cls):
        return "byte_files"

    def schema(self):
        return "file string, head binary, data binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def write_files(
    df: DataFrame, path: str, file: Column, data: Column, order: list[str], head: Column | None = None
) -> None:
    """Write ``data`` of all rows of a ``file``, ordered by ``order``, to path/file.

    ``head`` is the same in all rows of a file and written once, before them.
    """
    spark = df.sparkSession
    spark.dataSource.register(ByteFiles)
    head = F.lit(b"") if head is None else head
    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    (
        df.select(file.alias("file"), head.alias("head"), data.alias("data"), *keys)
        .repartition("file")
        .sortWithinPartitions("file", *[f"_o{i}" for i in range(len(order))])
        .select("file", "head", "data")
        .write.format("byte_files").mode("append").save(path)
    )
