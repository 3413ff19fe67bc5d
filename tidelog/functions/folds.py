"""Ordered folds: state machines over the rows of a key in order, with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], make: Callable, step: Callable, schema: str, end: Callable | None = None) -> DataFrame:
    """Rows that step(state, row) yields for the rows of each key in order, then those of end(state, key).

    make() gives a key's first state. Keys are dealt to partitions and sorted there, so a task holds one state and one Arrow
    batch, however many rows a key has.
    """
    names = df.columns
    spots = [names.index(k) for k in keys]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(parsed)
        now, state, out = None, None, []

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(target), target.types)], schema=target)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(row[i] for i in spots)
                if key != now:
                    if end and now is not None:
                        out.extend(end(state, now))
                    now, state = key, make()
                out.extend(step(state, dict(zip(names, row))))
                if len(out) >= 5000:
                    yield flush()
        if end and now is not None:
            out.extend(end(state, now))
        yield flush()

    parsed = df.sparkSession.createDataFrame([], schema).schema
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, parsed)
