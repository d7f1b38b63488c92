"""Streaming: every micro-batch of documents through the batch plan, appended once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkspan.functions import features as X
from inkspan.functions import normalize as N


def stream_features(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Document features of Parquet files as they arrive; the batch id in the path makes a replayed batch overwrite itself."""

    def batch(df: DataFrame, epoch: int) -> None:
        f = X.document_features(N.sentences(df.filter("text is not null")))
        f.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    docs = spark.readStream.schema(schema).parquet(source)
    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
