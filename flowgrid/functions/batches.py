"""Small groups of rows handed to Python many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that are put together before they are worked on; a group that is larger comes whole.
ROWS = 1 << 17

#: (columns, group of each row from 0, key of each group) -> columns.
Work = Callable[[dict[str, np.ndarray], np.ndarray, pa.Array], pa.Table]


def changes(keys: pa.Array) -> np.ndarray:
    """The places (but the first) at which sorted keys differ from the one before; missing keys are alike."""
    a, b = keys.slice(1), keys.slice(0, max(0, len(keys) - 1))
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1


def in_groups(df: DataFrame, key: str, order: list[str], work: Work, schema: str) -> DataFrame:
    """What work makes of the rows of df, groups of `key` in the order of `order`: whole groups, some ROWS rows at a time.

    Rows are sorted by Spark and read as a stream, so a task holds ROWS rows or its largest group.  Work gets the columns
    other than key as arrays.
    """
    names = [c for c in df.columns if c != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cuts = changes(whole(table[key]))
            if len(cuts):
                yield from done(table.slice(0, cuts[-1]))
                table = table.slice(cuts[-1])
            held, n = table.to_batches(), len(table)
            most = max(ROWS, 2 * n)
        if n:
            yield from done(pa.Table.from_batches(held).combine_chunks())

    def whole(column: pa.ChunkedArray) -> pa.Array:
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)

    def done(table: pa.Table) -> list[pa.RecordBatch]:
        keys = whole(table[key])
        first = np.append(0, changes(keys))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        columns = {c: whole(table[c]).to_numpy(zero_copy_only=False) for c in names}
        return work(columns, group, keys.take(pa.array(first))).to_batches()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
