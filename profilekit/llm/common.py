"""What the text operators share: reading two columns of a table, walking Arrow batches, digests."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts become Python strings in slices of about so many bytes.
_SLICE_BYTES = 1 << 22

#: White space of the dedup and shingle contracts, as a Java and Python character class.
BLANK_CLASS = r"[\x20\x09-\x0D]"


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; other columns are not read, a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "name type, name type"; workers have no session that could parse it."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def slices(batch, column: str = "text", most: int = _SLICE_BYTES):
    """(start, texts) of a batch in slices of at most about ``most`` bytes, one text at least; a null text is empty."""
    texts = batch.column(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        upto = (sizes[start - 1] if start else 0) + most
        stop = max(start + 1, int(np.searchsorted(sizes, upto, side="right")))
        yield start, [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop


def give_back() -> None:
    """Free memory of this worker goes back to the system: Spark keeps workers for later tasks, beside those that run then."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def per_text(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], ddl: str) -> DataFrame:
    """Apply a function to batches of (doc_id, text); ``make`` runs once per task and returns it.

    Batches are whatever Spark hands over (bounded by rows and bytes), so memory follows
    one batch and not the table.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, schema = make(), arrow_schema(ddl)
        for batch in batches:
            if batch.num_rows:
                found = work(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict({f.name: found[f.name] for f in schema}, schema=schema)

    return df.mapInArrow(run, ddl)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
