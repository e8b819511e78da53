"""Whole texts in Python: Arrow batches are worked on in slices, so that memory follows neither their rows nor
their length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19  # bytes of the texts that are Python objects at once; a longer text is a slice of its own


def slices(rows: pa.Array | pa.RecordBatch, texts: pa.Array | None = None) -> Iterator[pa.Array | pa.RecordBatch]:
    """`rows` in order, cut where their `texts` (by default they themselves) fill a slice."""
    sizes = pc.fill_null(pc.binary_length(rows if texts is None else texts), 0)
    upto = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
        yield rows.slice(at, end - at)
        at = end


def sliced(f: Callable[[list], pa.Array], texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """What `f` gives for each slice's texts, as one array."""
    return pa.concat_arrays([pa.array([], kind), *(f(s.to_pylist()) for s in slices(texts))])
