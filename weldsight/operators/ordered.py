"""One pass over each key's rows in order, with a state: for what the rows before decide and no window can say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_pass(df: DataFrame, key: str, order: str, columns: list[str], schema: str, step: Callable) -> DataFrame:
    """``step(state or None, row of columns)`` gives (state, output values or None) for each row; outputs follow key and
    order. Rows come Arrow batch by Arrow batch, sorted by Spark, so that a key's rows are never held together."""
    kinds = dict(df.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {schema}"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], out).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            rows = []
            names, places, *values = (c.to_pylist() for c in b.columns)
            for name, at, *row in zip(names, places, *values, strict=True):
                if name != now:
                    now, state = name, None
                state, made = step(state, row)
                if made is not None:
                    rows.append((name, at, *made))
            cells = zip(*rows, strict=True) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow, strict=True)], schema=arrow)

    return df.select(key, order, *columns).repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(run, out)
