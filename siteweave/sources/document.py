"""Sink for one text file that many tasks write at once: a batch writer of the DataSource V2 API.

Rows are (offset, text): where the bytes of the text belong in the file.  Tasks write at their own offsets, so a repeated or
speculative task writes the same bytes again.  The file has a hidden name until all tasks are done; the commit compares its
size with what the tasks report and gives it its name, so a reader sees a whole file or none.  The folder must be a
file system that driver and executors mount.
"""

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FILE = "part-document.json"
SCHEMA = "offset LONG, text STRING"


@dataclass
class Written(WriterCommitMessage):
    size: int


class OffsetWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.hidden = os.path.join(folder, f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        size = 0
        target = os.open(self.hidden, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                for offset, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    done = 0
                    while done < len(text):
                        done += os.pwrite(target, text[done:], offset + done)
                    size += len(text)
            os.fsync(target)
        finally:
            os.close(target)
        return Written(size)

    def commit(self, messages: list) -> None:
        size = sum(m.size for m in messages if m is not None)
        found = os.path.getsize(self.hidden)
        if found != size:
            raise OSError(f"the document has {found} bytes, {size} were written")
        os.replace(self.hidden, os.path.join(self.folder, FILE))

    def abort(self, messages: list) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siteweave_document"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> OffsetWriter:
        return OffsetWriter(self.options["path"].removeprefix("file:"))


def write(rows: DataFrame, folder: str) -> None:
    """Write (offset, text) rows as one file in ``folder``; an earlier document there is replaced."""
    rows.sparkSession.dataSource.register(DocumentSource)
    rows.select("offset", "text").write.format(DocumentSource.name()).mode("append").save(folder)
