"""Row-at-a-time logic over Arrow batches, without pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_batches(df: DataFrame, work: Callable[[], Callable[[list[list]], Iterable[tuple]]], schema: str) -> DataFrame:
    """work() is called once a task and returns a function from the columns of a batch (lists) to result rows."""
    target = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            rows = list(step([c.to_pylist() for c in batch.columns]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, target)
