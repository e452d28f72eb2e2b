"""Whole runs of equal keys from the sorted batches of a partition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def _changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a row differs from the one before it in one of ``keys``, which hold no nulls."""
    out = np.zeros(len(table), bool)
    for k in keys:
        codes = table[k].combine_chunks().dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        values = codes.indices.to_numpy(zero_copy_only=False)
        out[1:] |= values[1:] != values[:-1]
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """(table, edges) with whole runs of rows of equal ``keys``; run i is rows ``edges[i]`` to ``edges[i + 1]``.

    The rows of the last run of a batch wait for the next batch, so memory holds a batch and the longest run.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if all(rest[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in keys):
            continue
        table = pa.Table.from_batches(rest).combine_chunks()
        edges = [0, *np.flatnonzero(_changes(table, keys)).tolist()]
        yield table.slice(0, edges[-1]), edges
        rest = table.slice(edges[-1]).to_batches()
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, [0, *np.flatnonzero(_changes(table, keys)).tolist(), len(table)]
