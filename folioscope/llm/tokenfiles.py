"""Token files: equal-length sequences and masks as Arrow files.

A file is an Arrow IPC file of record batches with the columns

* ``ids``: fixed-size list of ``length`` unsigned integers (16 bits where the
  vocabulary allows it, else 32),
* ``mask``: fixed-size list of ``length`` booleans, false at padding,
* ``doc_ids``, ``doc_starts``: which documents start in the sequence, and where.

Its batches hold ``ROWS`` sequences each (fewer in the last), so sequence ``i`` is
row ``i % ROWS`` of batch ``i // ROWS`` and, with the file mapped to memory, a view of
its bytes: no parsing, no copy.  Documents fill a file without gaps; only a file's
last sequence is padded.  The files of a table, in the order of their names, hold
the documents in ascending ``doc_id`` order; a file holds about ``FILE_TOKENS`` tokens.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import text_batches
from folioscope.llm.tokens import encoder

ROWS = 64
FILE_TOKENS = 1 << 23
_WRITTEN = "file string, part int, number int, n_tokens long, n_docs long"
_READ = "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _schema(length: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema({"ids": pa.list_(ids, length), "mask": pa.list_(pa.bool_(), length),
                      "doc_ids": pa.list_(pa.int64()), "doc_starts": pa.list_(pa.int32())})


class _File:
    """One token file in the making: whole batches leave memory as they fill."""

    def __init__(self, folder: str, name: str, length: int, ids: pa.DataType):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.draft, self.path, self.name = f"{root}/_draft-{uuid.uuid4().hex}", f"{root}/{name}", name
        self.schema, self.length, self.ids = _schema(length, ids), length, ids
        self.sink = self.fs.open_output_stream(self.draft)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.held_tokens, self.done, self.docs = [], 0, 0, []
        self.tokens = self.n_docs = 0

    def add(self, doc_ids: list, offsets: np.ndarray, ids: np.ndarray) -> None:
        self.docs += zip(doc_ids, (offsets[:-1] + self.tokens).tolist())
        self.n_docs += len(doc_ids)
        self.held.append(ids)
        self.held_tokens += len(ids)
        self.tokens += len(ids)
        block = ROWS * self.length
        if self.held_tokens >= block:
            flat = np.concatenate(self.held)
            whole = len(flat) // block * block
            for at in range(0, whole, block):
                self._write(flat[at:at + block])
            self.held, self.held_tokens = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray) -> None:
        n, length = -(-len(flat) // self.length), self.length
        padded = np.zeros(n * length, self.ids.to_pandas_dtype())
        padded[:len(flat)] = flat
        stop = self.done + n * length
        rows: list[tuple[list, list]] = [([], []) for _ in range(n)]
        cut = 0
        for doc_id, start in self.docs:
            if start >= stop:
                break
            row, at = divmod(start - self.done, length)
            rows[row][0].append(doc_id)
            rows[row][1].append(at)
            cut += 1
        self.docs = self.docs[cut:]
        mask = pa.array(np.arange(n * length) < len(flat))
        self.out.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(padded), length), pa.FixedSizeListArray.from_arrays(mask, length),
            pa.array([x for x, _ in rows], pa.list_(pa.int64())), pa.array([x for _, x in rows], pa.list_(pa.int32()))], schema=self.schema))
        self.done = stop

    def close(self) -> tuple[str, int, int]:
        if self.held_tokens:
            self._write(np.concatenate(self.held))
        self.out.close()
        self.sink.close()
        self.fs.move(self.draft, self.path)  # a repeated task leaves the same file
        return self.name, self.tokens, self.n_docs


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int, length: int = 1024, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files; one row per file, by name.

    ``folder`` is a URI that all executors reach and that has no token files yet.
    Null and empty texts are the end token alone; null ids come first, documents
    of equal id by their text's hash.  Other columns are ignored; an empty table
    writes no file.  The returned rows (file, n_tokens, n_docs, first_token) give each
    file's place in the whole; they are written to ``folder/_files`` too.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = encoder(tokenizer_file)
        ids_type = pa.uint16() if max(code.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else pa.uint32()
        part, number, out = TaskContext.get().partitionId(), 0, None
        for batch in text_batches(batches):
            ids, offsets, _ = code.encode(batch.column(1).to_pylist(), end_id)
            if out is None:
                out = _File(folder, f"part-{part:06d}-{number:06d}.arrow", length, ids_type)
            out.add(batch.column(0).to_pylist(), offsets, ids)
            if out.tokens >= file_tokens:
                yield _file_row(part, number, *out.close())
                number, out = number + 1, None
        if out is not None:
            yield _file_row(part, number, *out.close())

    pa.fs.FileSystem.from_uri(folder)[0].create_dir(pa.fs.FileSystem.from_uri(folder)[1], recursive=True)
    rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").mapInArrow(run, _WRITTEN).write.parquet(f"{folder}/_written")
    files = spark.read.schema(_WRITTEN).parquet(f"{folder}/_written")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    placed = files.select("file", "n_tokens", "n_docs", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token"))
    placed.write.parquet(f"{folder}/_files")
    return spark.read.schema(placed.schema).parquet(f"{folder}/_files")


def _file_row(part: int, number: int, name: str, tokens: int, n_docs: int) -> pa.RecordBatch:
    return pa.record_batch({"file": [name], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_tokens": [tokens], "n_docs": [n_docs]})


def documents_in(source: pa.Buffer | pa.NativeFile) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Each document of a token file: its id, where it starts there, its ids."""
    reader = pa.ipc.open_file(source)
    doc_id, start, parts, at, open_ = None, 0, [], 0, False
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        length = batch.schema.field("ids").type.list_size
        flat = batch.column(0).flatten().to_numpy()
        used = int(batch.column(1).flatten().true_count)
        starts, names = batch.column(3), batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), np.asarray(starts.value_lengths()))
        begins = (row * length + np.asarray(starts.flatten())).tolist()
        for begin, name in zip(begins, names.flatten().to_pylist()):
            if open_:
                parts.append(flat[at:begin])
                yield doc_id, start, np.concatenate(parts)
            doc_id, start, parts, at, open_ = name, i * ROWS * length + begin, [], begin, True
        if open_:
            parts.append(flat[at:used])
        at = 0
    if open_:
        yield doc_id, start, np.concatenate(parts)


def sequence(path: str, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence ``i`` of a local file, as views of the mapped file."""
    with pa.memory_map(path) as source:
        reader = pa.ipc.open_file(source)
        batch = reader.get_batch(i // ROWS)
        row = i % ROWS
        length = batch.schema.field("ids").type.list_size
        return batch.column(0).flatten()[row * length:(row + 1) * length].to_numpy(), batch.column(1).flatten()[row * length:(row + 1) * length]


def read_token_files(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files.

    ``start`` counts the tokens of all documents before it.  Files are read by
    Spark's own reader, so any store will do.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs = [(name, d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in documents_in(content.as_buffer())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*docs), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["file", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    if files is None:
        files = spark.read.parquet(f"{folder}/_files")
    found = files.select("file").limit(1).count()
    if not found:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    held = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.arrow").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    # one file at a time in a worker
    docs = held.mapInArrow(run, _READ)
    return docs.join(files.select("file", "first_token"), "file").select("doc_id", (F.col("first_token") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
