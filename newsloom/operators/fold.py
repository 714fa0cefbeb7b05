"""Folds over the rows of each key in order, with a state that Spark's windows can't carry.

Rows are sorted by key and order within a partition and streamed through Python, batch after batch;
what is held is one state, never a key's history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(rows: DataFrame, key: str, order: list[str], step: Callable, schema: str, end: Callable | None = None) -> DataFrame:
    """What `step(state, row) -> (state, row out or None)` gives for each row of a key, and `end(key, state)` after its last; a key begins with None."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != now:
                    if begun and end:
                        out.append(end(now, state))
                    now, state, begun = row[key], None, True
                state, told = step(state, row)
                if told is not None:
                    out.append(told)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if begun and end:
            yield pa.RecordBatch.from_pylist([end(now, state)], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
