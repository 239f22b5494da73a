"""One text file from rows in order: a data source writer whose commit joins the parts.

The rows' order is that of their partitions, as ``orderBy`` leaves them, so that no task holds more than its range.  Each
task writes a part of its own name; the commit copies the parts of the tasks that it is told of, in order and after the header, to a
staged file, and moves this to its place.  A task that is repeated leaves a part that nobody names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from anchorline.sources.collection import _opened

_COPY = 1 << 23


@dataclass
class _Part(WriterCommitMessage):
    task: int
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, header: str):
        self.path, self.header = path, header
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        where, parts = _opened(self.parts)
        where.create_dir(parts, recursive=True)
        path = f"{parts}/{uuid.uuid4().hex}"
        with where.open_output_stream(path) as out:
            for batch in iterator:
                lines = batch.column("line").to_pylist()
                out.write("".join(f"{x}\n" for x in lines).encode())
        return _Part(TaskContext.get().partitionId(), path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, final = _opened(self.path)
        staged = f"{final}.{uuid.uuid4().hex}.tmp"
        where.create_dir(final.rpartition("/")[0] or ".", recursive=True)
        with where.open_output_stream(staged) as out:
            if self.header:
                out.write(f"{self.header}\n".encode())
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.task):
                with where.open_input_stream(part.path) as source:
                    while piece := source.read(_COPY):
                        out.write(piece)
        where.move(staged, final)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, parts = _opened(self.parts)
        if where.get_file_info(parts).type == fs.FileType.Directory:
            where.delete_dir(parts)


class OrderedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("header", ""))


def write_lines(rows: DataFrame, path: str, header: bool = False) -> None:
    """The columns of ordered rows as one tab-separated file, nulls as empty cells; it takes the place of an earlier one."""
    rows.sparkSession.dataSource.register(OrderedText)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]
    writer = rows.select(F.concat_ws("\t", *cells).alias("line")).write.format("ordered_text").mode("append")
    writer.option("header", "\t".join(rows.columns) if header else "").save(path)
