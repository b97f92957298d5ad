"""Arrow batches worked on in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a batch that are worked on at once.
PIECE = 1 << 20


def pieces(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Rows of a batch in pieces of about ``PIECE`` bytes, so that what Python makes of them does not grow with the batch."""
    size = max(1, sum(c.nbytes for c in columns) // PIECE)
    step = max(1, -(-len(columns[0]) // size))
    for at in range(0, len(columns[0]), step):
        yield tuple(c.slice(at, step) for c in columns)


def values(column: pa.Array) -> list:
    """A column's values; a text that is the same in every row is made once."""
    if not pa.types.is_string(column.type):
        return column.to_pylist()
    if len(column) > 1 and len(pc.unique(column[:2])) == 1 and len(same := pc.unique(column)) == 1:
        return same.to_pylist() * len(column)
    return column.to_numpy(zero_copy_only=False).tolist()


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
