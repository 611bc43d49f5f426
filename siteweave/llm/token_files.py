"""Token files: equal-length sequences of ids with masks, as Arrow streams, and their reader.

``write_tokens`` range-partitions documents by id, so part files in order hold the documents in ascending order.  Each
task encodes its documents, appends the end id to each, and writes two Arrow streams:

* ``tokens-<part>-<attempt>.arrows``: batches of ``ids`` (fixed_size_list<uint16 or uint32>[length]) and ``mask``
  (fixed_size_list<bool>[length], false on the padding of the last sequence).  The documents of a part fill the
  sequences without gaps.  Buffers are not compressed and all batches but the last have the same size, so ``sequence``
  finds any sequence of a memory-mapped file by its number, without a copy and without reading those before it.
* ``index-<part>-<attempt>.arrows``: doc_id, start within the part, n_tokens, in order.

A task returns one manifest row; only files named in the manifest count, so a repeated attempt (a lost executor) never
adds or changes data.  ``read_tokens`` maps the listed files and returns one row per document.

The target is a folder that all executors reach (file:, or any scheme of ``pyarrow.fs``).

Defined cases: null and empty texts have the end id alone; null ids come last; repeated ids are documents of their own,
in the order of a hash of their text; an empty table gives no files and an empty result; other columns are not looked at.
"""

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from siteweave.llm.encode import encoder, tokenizer_path
from siteweave.llm.words import slices
from siteweave.session import shared_dir, staged

LENGTH = 1024           # ids of a sequence
BATCH_SEQUENCES = 1024  # sequences of a record batch
END_ID = 1


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them in batches."""

    def __init__(self, sink: pa.NativeFile, length: int, wide: bool):
        self.length, self.dtype = length, np.uint32 if wide else np.uint16
        ids = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.dtype))
        self.held += len(ids)
        full = self.length * BATCH_SEQUENCES
        if self.held >= full:
            whole = np.concatenate(self.waiting)
            cut = len(whole) // full * full
            for at in range(0, cut, full):
                self._write(whole[at:at + full])
            self.waiting, self.held = [whole[cut:]], len(whole) - cut

    def _write(self, ids: np.ndarray) -> None:
        padding = -len(ids) % self.length
        mask = np.r_[np.ones(len(ids), bool), np.zeros(padding, bool)]
        ids = np.r_[ids, np.zeros(padding, self.dtype)]
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        whole = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        for at in range(0, len(whole), self.length * BATCH_SEQUENCES):
            self._write(whole[at:at + self.length * BATCH_SEQUENCES])
        self.writer.close()


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part long, tokens string, documents string, n_documents long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Write the token files of ``docs`` (doc_id, text) to ``folder``; returns the manifest, one row per part, staged."""
    path = tokenizer or tokenizer_path()
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    system, root = _open(folder)
    system.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        system, root = _open(folder)
        tokens, index = f"{root}/tokens-{name}.arrows", f"{root}/index-{name}.arrows"
        encode = encoder(path)
        wide = encode.tokenizer.get_vocab_size() > 1 << 16
        writers = None
        documents = total = 0
        for batch, texts in slices(batches):
            if writers is None:
                sinks = [system.open_output_stream(tokens), system.open_output_stream(index)]
                writers = SequenceWriter(sinks[0], length, wide), pa.ipc.new_stream(sinks[1], INDEX)
            ids, sizes = encode.flat(texts)
            writers[0].add(np.insert(ids, np.cumsum(sizes), end_id))
            sizes = sizes + 1
            starts = total + np.cumsum(sizes) - sizes
            writers[1].write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts), pa.array(sizes)], schema=INDEX))
            documents, total = documents + len(sizes), total + int(sizes.sum())
        if writers is not None:
            for writer, sink in zip(writers, sinks):
                writer.close()
                sink.close()
            yield pa.RecordBatch.from_pylist([{"part": context.partitionId(), "tokens": tokens, "documents": index, "n_documents": documents, "n_tokens": total}])

    return staged(ordered.mapInArrow(run, MANIFEST))


def _stream(system: fs.FileSystem, path: str) -> pa.RecordBatchReader:
    source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
    return pa.ipc.open_stream(source)


def sequences(folder: str, tokens: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, mask) of each batch of one file, as two-dimensional arrays; ids of a local file are views of the mapped file."""
    for batch in _stream(_open(folder)[0], tokens):
        width = batch.schema.field("ids").type.list_size
        ids, mask = batch.column("ids"), batch.column("mask")
        yield ids.flatten().to_numpy().reshape(-1, width), mask.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sequence(folder: str, tokens: str, number: int) -> tuple[np.ndarray, pa.FixedSizeListScalar]:
    """(ids, mask) of one sequence of a file, by its number; those of a local file are views of the mapped file.

    The first batch's header gives the size of every full batch, so the wanted one is found by arithmetic.
    """
    system = _open(folder)[0]
    source = pa.memory_map(tokens) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(tokens)
    if number < 0:
        raise IndexError(number)
    schema = pa.ipc.read_schema(source)
    begin = source.tell()
    first = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    batch, row = first, number
    if number >= first.num_rows:
        at = begin + number // first.num_rows * (source.tell() - begin)
        if at >= source.size():
            raise IndexError(number)
        source.seek(at)
        try:
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
        except EOFError:
            raise IndexError(number) from None
        row = number % first.num_rows
    if row >= batch.num_rows:
        raise IndexError(number)
    width = schema.field("ids").type.list_size
    return batch.column("ids").flatten()[row * width:(row + 1) * width].to_numpy(), batch.column("mask")[row]


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per part
    listed = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _open(folder)[0]
        for part in (row for batch in batches for row in batch.to_pylist()):
            stream = (ids[mask] for ids, mask in sequences(folder, part["tokens"]))
            held = np.zeros(0, np.uint32)
            for index in _stream(system, part["documents"]):
                sizes = index.column("n_tokens").to_numpy()
                blocks, need = [held], int(sizes.sum()) - len(held)
                while need > 0:
                    blocks.append(next(stream))
                    need -= len(blocks[-1])
                flat = np.concatenate(blocks).astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(flat[e - n:e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                held = flat[int(ends[-1]) if len(ends) else 0:]
                start = index.column("start").to_numpy() + part["before"]
                yield pa.RecordBatch.from_arrays([index.column("doc_id"), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(files, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files to a new shared folder and read them back."""
    spark = docs.sparkSession
    folder = os.path.join(shared_dir(spark), "tokens-" + uuid.uuid4().hex)
    return read_tokens(spark, folder, write_tokens(docs, folder, tokenizer))
