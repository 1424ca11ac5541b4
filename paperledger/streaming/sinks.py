"""Tables that grow by one partition for each batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from paperledger.operators.ledger import onboard

Make = Callable[[DataFrame, DataFrame], DataFrame]


def read_grown(spark: SparkSession, folder: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before one. An empty table if nothing was written yet."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(folder)
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


def grow(stream: DataFrame, folder: str, checkpoint: str, schema: T.StructType, make: Make) -> DataStreamWriter:
    """A writer that adds ``make(batch, rows so far)`` to the table in ``folder``.

    A batch has a partition of its own, written anew if the batch is repeated,
    and sees only the batches before it: each row is there exactly once.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/batch=-1")

    def add(batch: DataFrame, number: int) -> None:
        held = read_grown(batch.sparkSession, folder, schema, before=number)
        new = make(batch, held).select(*schema.names)
        new.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def onboard_stream(messages: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """New users with business and role, once for each phone number, from a message stream."""
    schema = onboard(messages, messages.select("user_phone")).schema
    return grow(messages, folder, checkpoint, schema, onboard)


def settings_stream(changes: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Setting changes as they come; ``latest_settings`` over ``read_grown`` gives the state."""
    return grow(changes, folder, checkpoint, changes.schema, lambda batch, _: batch)


def counted(steps: DataFrame) -> DataFrame:
    """The steps of a stream, with the number of reminders, expiries, logged and undone bills of each batch observed."""
    event = lambda *names: F.count_if(F.col("event").isin(*names)).alias(names[0])
    return steps.observe("steps", event("nudged"), event("expired"), event("auto_logged"), event("confirmed"), event("undone"), F.count("*").alias("steps"))


COUNTERS = "batch long, nudged long, expired long, auto_logged long, confirmed long, undone long, steps long, late long"


def counters(query: StreamingQuery) -> DataFrame:
    """``COUNTERS`` of the batches whose progress the query still holds: what was observed, and the rows that came behind the watermark."""
    names = [part.split()[0] for part in COUNTERS.split(", ")]
    rows = []
    for progress in query.recentProgress:
        seen = progress.observedMetrics.get("steps")
        late = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        rows.append((progress.batchId, *(seen[n] if seen is not None else 0 for n in names[1:-1]), late))
    return SparkSession.active().createDataFrame(rows, COUNTERS)
