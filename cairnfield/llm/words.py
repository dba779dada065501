"""Words of whole texts as numpy arrays, for operators that run in Arrow batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is what
``bytes.split()`` gives. Null texts have no words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import StructType

#: Bytes of text that are held as words at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 8 << 20


def binary(column) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], text: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with chunk_bytes of text at most (or one row)."""
    for batch in batches:
        column = batch.column(text)
        start = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            if i > start and size + n > chunk_bytes:
                yield batch.slice(start, i - start), binary(column.slice(start, i - start))
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start), binary(column.slice(start))


def encode(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(codes of all words in order, offset of each text's first word plus the end, distinct words)."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    parts, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        words = (t.lower() if lower else t).split() if t else []
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        offsets[i + 1] = offsets[i] + len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), offsets, list(ids)


def grown(schema: StructType, ddl: str) -> StructType:
    """A schema with more fields at its end (StructType.add would change the one given)."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until no taken column has them in any case."""
    used = {c.lower() for c in taken}
    while used & {n.lower() for n in names}:
        names = tuple(f"_{n}" for n in names)
    return list(names)
