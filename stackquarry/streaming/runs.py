"""Running a stream to the end of its present input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stackquarry.sources.checkpoints import new_table_path


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Append-mode stream into a parquet table; returns that table."""
    table = new_table_path(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", f"{table}-progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)
