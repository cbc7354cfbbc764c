"""New or changed chunk files drive incremental maintenance of a store, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import store as ops
from corpusloom.plans.maintenance import StoreTable, index_incremental


def maintain(spark: SparkSession, chunk_files: str, schema: str, table: StoreTable, checkpoint: str, whole_sources: bool = False) -> StreamingQuery:
    """Runs over all files that have come since the last run and stops (``availableNow``).

    A batch upserts its chunks by id, so a batch that is repeated after a failure changes nothing. With ``whole_sources`` a batch holds all
    chunks of each source that it has, so that what such a source no longer holds is deleted. Only the parts of the
    store in which a batch's sources lie are read and rewritten.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        sources = batch.select("source").distinct()
        store = table.read(schema, sources)
        table.write(index_incremental(store, batch)[0] if whole_sources else ops.upsert(store, batch), sources)

    stream = spark.readStream.schema(schema).parquet(chunk_files)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
