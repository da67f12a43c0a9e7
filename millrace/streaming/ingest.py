"""Incremental ingest of files: each record is stored once, however often it is delivered."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.session import is_directory, own_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def ingest_stream(spark: SparkSession, source: str, key: str, store: str | None = None) -> DataFrame:
    """Read new Parquet files below ``source`` and append the records whose ``key`` is not in ``store`` yet; the store's rows.

    Takes what is there and ends. The keys met are the stream's state, split by key and kept on disk (RocksDB), so a batch costs by its
    own size and not by the store's. Position, state and store lie in the shared folder: a run that was broken off goes on where it
    stopped, and a batch that was written before replaces itself, as each batch owns a folder. Null is a key like any other;
    of several rows with one key one is kept.
    """
    at = store or f"{own_dir(spark)}/store-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
    folder, _, name = source.rpartition("/")
    rows = stream.parquet(source) if is_directory(spark, source) else stream.option("pathGlobFilter", name).parquet(folder)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/{number}")

    session_wide = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = rows.dropDuplicates([key]).writeStream.foreachBatch(append).option("checkpointLocation", f"{at}/position").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, session_wide)
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/rows")
