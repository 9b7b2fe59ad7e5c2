"""Whole groups out of a partition that is sorted by its group key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewire.llm import kernels


def runs(reader, keys: list[str]):
    """Yield one Arrow table per run of equal ``keys``; only the run that a batch ends with is held over.

    The partition must hold each group whole and be sorted by ``keys``.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in kernels.lean(reader):
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            column = batch.column(k)
            change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
