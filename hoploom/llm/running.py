"""Running totals over a sorted table, across its partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _changes(batch, segment: Sequence[str], last: tuple | None) -> np.ndarray:
    """Whether each row's segment is not that of the row before it; ``last`` is the segment before the batch."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    for name in segment:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed[1:] |= codes[1:] != codes[:-1]
    changed[0] = last is None or _key(batch, segment, 0) != last
    return changed


def _key(batch, segment: Sequence[str], at: int) -> tuple:
    return tuple(batch.column(name)[at].as_py() for name in segment)


def running_totals(rows: DataFrame, order: Sequence[str], totals: Mapping[str, Column], segment: Sequence[str] = (), number: str | None = None) -> DataFrame:
    """``rows`` sorted by ``order``, with the running totals of whole numbers, the row itself included.

    Totals begin anew where the ``segment`` columns, with which ``order`` begins, change;
    ``number`` counts the segments from 0. The table is sorted by ranges and written
    once, so that both passes see the same rows; of each partition one row comes to the
    driver (its first and last segment, and the totals of the last). A segment may span
    any number of partitions.
    """
    names = list(totals)
    ranged = rows.withColumns({**dict(totals)}).repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    kinds = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    keys = ", ".join(f"`first_{k}` {kinds[c]}, `last_{k}` {kinds[c]}" for k, c in enumerate(segment))
    sums = ", ".join(f"`sum_{k}` long" for k in range(len(names)))

    def summary(batches):
        import pyarrow as pa

        first = last = part = kind = None
        changes, tail = 0, np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = _changes(batch, segment, last)
            part, kind = batch.column("_part")[0].as_py(), [batch.schema.field(c).type for c in segment]
            first = _key(batch, segment, 0) if first is None else first
            last = _key(batch, segment, batch.num_rows - 1)
            at = np.flatnonzero(changed)
            changes += len(at)
            start = int(at[-1]) if len(at) else 0
            own = np.array([batch.column(c).to_numpy(zero_copy_only=False)[start:].astype(np.int64).sum() for c in names], dtype=np.int64)
            tail = own if len(at) else tail + own
        if part is not None:
            ends = [(f"{end}_{k}", pa.array([key[k]], kind[k])) for k in range(len(segment)) for end, key in (("first", first), ("last", last))]
            row = [("_part", pa.array([part], pa.int32())), ("_changes", pa.array([changes - 1], pa.int64())), *ends, *((f"sum_{k}", pa.array([int(s)], pa.int64())) for k, s in enumerate(tail))]
            yield pa.RecordBatch.from_arrays([c for _, c in row], names=[n for n, _ in row])

    shape = ", ".join(x for x in ("_part int, _changes long", keys, sums) if x)
    found = sorted((r.asDict() for r in held.mapInArrow(summary, shape).collect()), key=lambda r: r["_part"])
    carried: dict[int, tuple] = {}
    last, count, tail = None, -1, [0] * len(names)
    for r in found:
        goes_on = last is not None and tuple(r[f"first_{k}"] for k in range(len(segment))) == last
        count, tail = (count, tail) if goes_on else (count + 1, [0] * len(names))
        carried[r["_part"]] = (count, list(tail))
        own = [r[f"sum_{k}"] for k in range(len(names))]
        tail = own if r["_changes"] else [a + b for a, b in zip(tail, own, strict=True)]
        count += r["_changes"]
        last = tuple(r[f"last_{k}"] for k in range(len(segment)))
    shared = rows.sparkSession.sparkContext.broadcast(carried)

    def add(batches):
        import pyarrow as pa

        last = before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = _changes(batch, segment, last)
            if last is None:
                count, start = shared.value[batch.column("_part")[0].as_py()]
                before = np.array(start, dtype=np.int64)
                changed[0] = False  # what is carried is for this segment
            place = np.cumsum(changed)
            out = {}
            starts = np.flatnonzero(changed)
            for k, name in enumerate(names):
                grown = np.cumsum(batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64))
                base = np.concatenate([[-before[k]], grown[starts - 1] if len(starts) else np.zeros(0, dtype=np.int64)])
                if len(starts) and starts[0] == 0:
                    base[1] = 0
                out[name] = grown - base[place]
            before = np.array([out[name][-1] for name in names], dtype=np.int64)
            numbers = count + place
            count, last = int(numbers[-1]), _key(batch, segment, batch.num_rows - 1)
            columns = [pa.array(out[c], pa.int64()) if c in out else batch.column(c) for c in batch.schema.names if c != "_part"]
            fields = [c for c in batch.schema.names if c != "_part"]
            if number:
                columns, fields = [*columns, pa.array(numbers, pa.int64())], [*fields, number]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    schema = [f"`{c}` {'bigint' if c in totals else kind}" for c, kind in kinds.items() if c != "_part"] + ([f"`{number}` bigint"] if number else [])
    return held.mapInArrow(add, ", ".join(schema))

