"""As-of values on a timeline: the latest value at or before each row of its key, for keys of any size.

A window would put all rows of a key into one task. Here the rows are sorted over all partitions once; a partition fills
values forward in its own rows, and takes from those before it only the value its first key had at their end. That is one
small row per partition, gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from sitelode.operators.stages import checkpointed


def filled_forward(rows: DataFrame, key: str, order: Sequence[str | Column], value: str) -> DataFrame:
    """``rows`` with the latest non-null ``value`` at or before each row of its ``key``, in the given ``order``.

    ``order`` should tell a key's rows apart, so that a crowded one can be cut anywhere. Rows of a null key keep their own value.
    """
    ordered = checkpointed(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order))
    kind = T.StructType([T.StructField("part", T.IntegerType())] + [T.StructField(n, rows.schema[c].dataType) for n, c in (("first", key), ("last", key), ("value", value))])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and last key of a partition, and the last value of the last key there."""
        first, last, held, types = None, None, None, None
        for batch in batches:
            keys, values = batch.columns
            if not len(keys):
                continue
            types = types or (keys.type, keys.type, values.type)
            first = keys[0] if first is None else first
            known = np.flatnonzero(np.asarray(values.is_valid()) & np.asarray(pc.fill_null(pc.equal(keys, keys[-1]), False)))
            if last is None or last.as_py() != keys[-1].as_py():
                held = None
            last = keys[-1]
            held = values[int(known[-1])] if len(known) else held
        if last is not None:
            cells = [pa.array([None if x is None else x.as_py()], t) for x, t in zip((first, last, held), types, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *cells], names=kind.names)

    carried, before = {}, None
    for end in sorted(ordered.select(key, value).mapInArrow(ends, kind).collect(), key=lambda r: r["part"]):
        if before and end["first"] is not None and before["key"] == end["first"]:
            carried[end["part"]] = before["value"]
        kept = end["value"] is None and end["first"] == end["last"]
        before = {"key": end["last"], "value": carried.get(end["part"]) if kept else end["value"]}

    names, at_key, at_value = ordered.columns, ordered.columns.index(key), ordered.columns.index(value)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is carried is of the first key, whatever it is.
        last, held, begun = None, carried.get(TaskContext.get().partitionId()), False
        for batch in batches:
            keys, values = batch.column(at_key), batch.column(at_value)
            n = len(keys)
            if not n:
                continue
            # Row 0 is what is held from before; it goes on into this batch's first key, if that is the same one.
            begins = np.ones(n, bool)
            begins[1:] = ~np.asarray(pc.fill_null(pc.equal(keys[1:], keys[:-1]), False))
            begins[0] = keys[0].as_py() is None or (begun and last != keys[0].as_py())
            rows_of = np.arange(1, n + 1)
            known = np.where(np.asarray(values.is_valid()), rows_of, 0)
            group = np.maximum.accumulate(np.where(begins, rows_of, 0))
            latest = np.maximum.accumulate(np.maximum(known, 0))
            # A value from before the row's key began is none of its own; at 0 the held one counts.
            inside = (latest >= group) & ((latest > 0) | (group == 0))
            all_values = pa.concat_arrays([pa.array([held], values.type), values])
            filled = all_values.take(pa.array(np.where(inside, latest, 0), mask=~inside))
            last, held, begun = keys[-1].as_py(), filled[-1].as_py(), True
            columns = list(batch.columns)
            columns[at_value] = filled
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ordered.mapInArrow(fill, ordered.schema)
