"""Whole groups from a sorted stream of rows, so that no task holds more than a pack of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups; rows come sorted by the keys, which are integers and not null. Groups that follow each other
    share a table until it has ``least`` rows."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in columns)
        last, begin = tuple(c[-1] for c in columns), 0
        for at in np.flatnonzero(new).tolist():
            if rows + at - begin >= least:
                held.append(batch.slice(begin, at - begin))
                yield pa.Table.from_batches(held)
                held, rows, begin = [], 0, at
        held.append(batch.slice(begin))
        rows += batch.num_rows - begin
    if rows:
        yield pa.Table.from_batches(held)


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of the table begins."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in keys:
        column = table.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)
