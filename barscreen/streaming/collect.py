"""Continuous collection of landed bars."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import store_series
from ..sources.readers import clean_equity, read_equity
from ..sources.store import Store


def stream_collect(
    spark: SparkSession,
    landing: str,
    store: Store,
    checkpoint: str,
    on_bad: str = "zero",
    max_files: int | None = None,
) -> StreamingQuery:
    """Upsert every new landing file into the bars table, then stop.

    The stream names the new files of a micro-batch, the batch reader reads them, each by its
    own header. A replayed micro-batch overwrites the same keys with the same rows, so a restart
    from the checkpoint changes nothing; late and corrected bars overwrite by key, so no
    watermark is needed.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def apply(batch: DataFrame, _: int) -> None:
        # names of the files of one trigger, which the driver has listed already
        files = [unquote(r["file"]) for r in batch.distinct().collect()]
        if files:
            raw = read_equity(batch.sparkSession, sorted(files))
            store_series(store, "daily_ohlcv", clean_equity(raw, on_bad))

    return (
        reader.text(landing)
        .select(F.col("_metadata.file_path").alias("file"))
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(apply)
        .start()
    )
