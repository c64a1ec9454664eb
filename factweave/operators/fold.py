"""Folds over the rows of a key in their order, with a state of constant size.

Rows are dealt out by key and sorted inside the partitions, and a task reads them as a stream of Arrow batches: what it holds is one batch and the state
of one key, so a key with a third of all rows is read through and never gathered. For rules that windows and aggregates can't say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: (state or None, row values) -> (next state, output values of the row, or None for no row)
Step = Callable[[object, tuple], tuple[object, tuple | None]]


def fold_in_order(df: DataFrame, key: str, order: tuple[str, ...], step: Step, added: str) -> DataFrame:
    """The rows (key, the order columns) with the columns ``added`` (a DDL list) that ``step`` gives, each from the state that the row before it left.

    ``step`` gets the order columns' values as Python values, times as microseconds. Equal keys are one run; null is a key like any other.
    """
    spark, kept = df.sparkSession, df.select(key, *order)
    dealt = kept.repartition(key).sortWithinPartitions(key, *order)
    schema = spark.createDataFrame([], added).schema
    out = kept.schema
    for field in schema:
        out = out.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [f.name for f in schema], None
        state, at, first = None, None, True
        for batch in batches:
            if types is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                types = [f.type for f in to_arrow_schema(schema)]
            keys = batch.column(0).to_pylist()
            columns = [c.cast(pa.int64()).to_pylist() if pa.types.is_timestamp(c.type) else c.to_pylist() for c in batch.columns[1:]]
            taken, values = [], []
            for i, row in enumerate(zip(*columns, strict=True)):
                if first or keys[i] != at:
                    state, at, first = None, keys[i], False
                state, said = step(state, row)
                if said is not None:
                    taken.append(i)
                    values.append(said)
            some = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array([v[j] for v in values], t) for j, t in enumerate(types)]], names=[*some.schema.names, *names])

    return dealt.mapInArrow(run, out)
