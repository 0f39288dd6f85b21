"""Token ids in Arrow files of fixed-size-list batches: equal-length sequences and masks, read without copies."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import binaries, slices
from quire.llm.tokens import tokenizer
from quire.storage import Scratch


def _open(path: str, write: bool = False):  # noqa: ANN202
    """A file of the shared folder, by any URI that Arrow knows; mapped into memory where it is local."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    if write:
        return system.open_output_stream(inner)
    return pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)


def sequence_schema(length: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids to a file as sequences of ``length``; the last one is filled with zeros that its mask leaves out."""

    def __init__(self, path: str, length: int, ids: pa.DataType, rows: int = 512):
        self.schema, self.length, self.rows = sequence_schema(length, ids), length, rows
        self.kind = ids.to_pandas_dtype()
        self.file = _open(path, True)
        self.out = pa.ipc.new_file(self.file, self.schema)
        self.rest = np.zeros(0, self.kind)

    def _write(self, ids: np.ndarray, masked: int) -> None:
        mask = np.ones(len(ids), bool)
        if masked:
            mask[-masked:] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def append(self, ids: np.ndarray) -> None:
        self.rest = np.concatenate([self.rest, ids.astype(self.kind)])
        block = self.length * self.rows
        cut = len(self.rest) // block * block
        for at in range(0, cut, block):
            self._write(self.rest[at : at + block], 0)
        self.rest = self.rest[cut:].copy()

    def close(self) -> None:
        if len(self.rest):
            fill = -len(self.rest) % self.length
            self._write(np.concatenate([self.rest, np.zeros(fill, self.kind)]), fill)
        self.out.close()
        self.file.close()


class SequenceReader:
    """Random access to the sequences of a file; arrays are views of the mapped file."""

    def __init__(self, path: str):
        self.reader = pa.ipc.open_file(_open(path))
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1

    def batch(self, k: int) -> np.ndarray:
        """Ids of a batch, one sequence after another."""
        column = self.reader.get_batch(k).column("ids")
        return column.values.to_numpy(zero_copy_only=True)[column.offset * self.length : (column.offset + len(column)) * self.length]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of one sequence."""
        batch = self.reader.get_batch(k // self.rows)
        at = k % self.rows
        return self.batch(k // self.rows)[at * self.length : (at + 1) * self.length], batch.column("mask")[at].values

    def spans(self, starts: list[int], counts: list[int]) -> Iterator[Iterator[np.ndarray]]:
        """For each ascending span of ids its parts."""
        block, k, held = self.rows * self.length, -1, None

        def parts(at: int, end: int) -> Iterator[np.ndarray]:
            nonlocal k, held
            while at < end:
                if at // block != k:
                    k, held = at // block, self.batch(at // block)
                here = at - k * block
                n = min(end - at, block - here)
                yield held[here : here + n]
                at += n

        for start, count in zip(starts, counts, strict=True):
            yield parts(start, start + count)


def write_token_files(docs: DataFrame, tokenizer_file: str, root: str, end: int = 2, length: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and write; one row for each pair of files: part, ids_path, docs_path, n_docs, n_tokens.

    Rows are dealt by ranges of the key and sorted in them, so files in order of ``part`` hold the documents in ascending
    order of keys (null first, equal keys by text). Each task writes files of names of its own: one that fails or runs
    twice leaves files that no row names. Ids are 16-bit where the vocabulary allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_file)
        kind = pa.uint16() if max(encoder.library.get_vocab_size(), end + 1) <= 1 << 16 else pa.uint32()
        part = TaskContext.get().partitionId()
        paths = [f"{root}/part-{part:06d}-{uuid.uuid4().hex}.{x}" for x in ("ids.arrow", "docs.arrow")]
        writer, names, sizes = None, [], []
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            writer = writer or SequenceWriter(paths[0], length, kind)
            ids, counts = encoder.encode(binaries(batch.column(1)))
            stop = np.cumsum(counts)
            writer.append(np.insert(ids, stop, np.uint32(end)))
            names.append(batch.column(0))
            sizes.append(counts + 1)
        if writer:
            writer.close()
            size = np.concatenate(sizes)
            table = pa.table({"key": pa.chunked_array(names), "start": np.cumsum(size) - size, "n_tokens": size})
            with _open(paths[1], True) as f, pa.ipc.new_file(f, table.schema) as out:
                out.write_table(table, 65536)
            yield pa.RecordBatch.from_pylist([{"part": part, "ids_path": paths[0], "docs_path": paths[1], "n_docs": len(size), "n_tokens": int(size.sum())}])

    rows = docs.select(key, text).withColumn("__tie", F.xxhash64(text))
    rows = rows.repartitionByRange(key, "__tie").sortWithinPartitions(key, "__tie").drop("__tie")
    return rows.mapInArrow(run, "part long, ids_path string, docs_path string, n_docs long, n_tokens long")


def read_token_files(files: DataFrame, key: str, kind: str) -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    tasks = max(1, files.count())  # one file a task: without a number the few rows would be merged into one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, index = SequenceReader(row["ids_path"]), pa.ipc.open_file(_open(row["docs_path"]))
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    starts, counts = docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()
                    sums = []
                    for parts in reader.spans(starts, counts):
                        crc = 0
                        for ids in parts:
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([docs.column("key"), pa.array([row["base"] + s for s in starts], pa.int64()), docs.column("n_tokens").cast(pa.int64()), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return files.select("base", "ids_path", "docs_path").repartitionByRange(tasks, "base").mapInArrow(run, f"{key} {kind}, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer_file: str, end: int = 2, length: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write all documents to token files in the shared folder and report each from the files.

    Null and empty texts: the end id alone. Null keys come first, repeated rows each have ids of their own. Empty table:
    no file, no row. A task holds 1 MB of text and a batch of sequences; a longer single text is held whole.
    """
    scratch = Scratch(docs.sparkSession)
    files = scratch.put(write_token_files(docs, tokenizer_file, scratch.root, end, length, text, key), "files")
    return read_token_files(files, key, dict(docs.dtypes)[key])
