"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.session import ship_package

#: Rows in an Arrow batch: bounds what a Python worker holds at once, also with long texts.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors and bound Arrow's batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], Iterator[dict]]]) -> DataFrame:
    """mapInArrow with plain lists.

    ``make`` is called once for each partition and returns a function from a batch (column name to list) to
    dictionaries of columns. After the last batch that function is called with None, so that it can give what it kept.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        gc.disable()  # the tables that steps keep have no cycles, and scanning them again and again costs a third of the time
        try:
            step = make()
            for batch in batches:
                if batch.num_rows:
                    columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
                    for out in step(columns) or ():
                        yield record(out, arrow)
            for out in step(None) or ():
                yield record(out, arrow)
        finally:
            step = columns = batch = out = None
            gc.enable()
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what a finished task has freed to the system: worker processes live on, idle ones should be small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, np.ndarray]], Iterator[dict]]]) -> DataFrame:
    """The same with numpy arrays, for columns of numbers without nulls."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                for out in step({name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}) or ():
                    yield record(out, arrow)
        for out in step(None) or ():
            yield record(out, arrow)

    return df.mapInArrow(run, schema)


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
