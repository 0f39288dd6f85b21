"""Identifiers and small helpers for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, \t, \n, \v, \f, \r. ``bytes.split()`` uses the same set.
WORD_BREAKS = r"[\x20\x09-\x0D]+"


def unit_hash(*parts: Column | str) -> Column:
    """52 hash bits as a double in [0, 1); md5, so that SQL elsewhere gives the same."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def long_hash(*parts: Column | str) -> Column:
    """60 hash bits as a long."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def binaries(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size, but for single rows above the bound. At the end of a task its worker, which
    waits for the next one, gives the memory that it no longer uses back."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
