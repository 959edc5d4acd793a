"""Tables that an operator stores between its steps, in the shared work folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import stored as stored

#: Bytes of the Arrow batches that stages of the pipeline send to Python, and rows that they read from Parquet at a time.
BATCH_BYTES, READ_ROWS = 1 << 20, 512
_BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python batches of bounded bytes (one longer row alone) and reads few rows at a time, unless it
    has bounds of its own.

    Batches are otherwise bounded by their rows only: thousands of texts take buffers of many MB, which executors keep when they
    are free again. The settings stay, as queries built now may run later.
    """
    for name, bound in _BOUNDS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(bound))


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
