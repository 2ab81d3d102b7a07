"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestream.session import reach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``df`` mapped by ``rows``, which takes and returns columns as Python lists, at most SLICE rows at a time.

    The slices bound what a worker holds as Python objects.
    """
    small_batches(df.sparkSession)
    from pyspark.sql.types import _parse_datatype_string

    target = pa_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                out = rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


#: Rows that are Python objects at one time, and of an Arrow batch at most: texts can be long, and an executor holds
#: several batches of each task.
SLICE = 500
BATCH = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH, if they aren't lower: there is no setting for one query."""
    reach(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def pa_schema(struct) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)
