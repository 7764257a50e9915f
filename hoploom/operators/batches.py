"""Groups of rows in Arrow batches."""

from __future__ import annotations

import numpy as np


def group_tables(batches, keys: list[str]):
    """(table, starts): Arrow tables of whole groups of rows with equal ``keys``, from batches that arrive sorted by them.

    ``starts`` has the first row of every group and the number of rows. A group may
    span batches; what is held is one group and one batch.
    """
    import pyarrow as pa

    held: list = []

    def starts_of(table) -> np.ndarray:
        changed = np.zeros(table.num_rows, dtype=bool)
        for key in keys:
            column = table.column(key).to_numpy()
            changed[1:] |= column[1:] != column[:-1]
        changed[:1] = True
        return np.append(np.flatnonzero(changed), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() for k in keys] if held else None
        if last is not None and all(batch.column(batch.schema.get_field_index(k))[-1].as_py() == v for k, v in zip(keys, last, strict=True)):
            held.append(batch)  # the group goes on to the end of this batch
            continue
        whole = pa.Table.from_batches([*held, batch]).combine_chunks()
        starts = starts_of(whole)
        cut = int(starts[-2])
        held = whole.slice(cut).combine_chunks().to_batches()
        if cut:
            yield whole.slice(0, cut).combine_chunks(), starts[:-1]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, starts_of(whole)


def list_arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends): a list column's values one after the other, and where each row's begin and end (rows + 1 offsets)."""
    import pyarrow as pa

    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    offsets = array.offsets.to_numpy().astype(np.int64)
    return array.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]
