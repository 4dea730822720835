"""Entries that arrive as a stream, added to a library once each. An extension: the batch
operators need no event time or state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.library import upsert


def append_new(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends to the Parquet library at path those entries of each batch whose
    key and DOI it lacks. A batch that is tried again finds its rows there and adds nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        try:
            have = spark.read.schema(rows.schema).parquet(path)
            new = upsert(have.select("key", "doi"), rows).join(have.select("key"), "key", "left_anti").select(*rows.columns)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = upsert(rows.limit(0), rows)
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
