"""Whole runs of equal keys from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables cut only where ``columns`` change, from batches sorted by them: a run is never split."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        last = [table.column(c)[table.num_rows - 1] for c in columns]
        lo, hi = 0, table.num_rows - 1  # first row of the last run, by bisection over the sorted rows
        while lo < hi:
            mid = (lo + hi) // 2
            if [table.column(c)[mid] for c in columns] == last:
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield table.slice(0, lo).combine_chunks()
        held = table.slice(lo)
    if held is not None and held.num_rows:
        yield held.combine_chunks()
