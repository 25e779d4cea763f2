"""Complete groups from a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Indices at which one of the key columns (64-bit integers without nulls) differs from the row before."""
    n = table.num_rows
    edge = np.zeros(n, dtype=bool)
    edge[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        edge[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(edge)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold only complete groups, with the starts of the groups. The rows must arrive
    sorted by the keys; besides one batch, at most one group is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        starts = changes(now, keys)
        if held and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in keys):
            first_end = int(starts[1]) if len(starts) > 1 else now.num_rows
        else:
            first_end = 0
        if held and first_end < now.num_rows or not held and len(starts) > 1:
            last = int(starts[-1])
            done = pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])])
            held = [batch.slice(last)]
            yield done.combine_chunks(), changes(done, keys)
        else:
            held.append(batch)
    if held:
        done = pa.Table.from_batches(held)
        yield done.combine_chunks(), changes(done, keys)
