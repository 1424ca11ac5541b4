"""Token buckets: how many messages of a user pass, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RATE, BURST = 30, 60
MINUTE = 60_000
_ORDER = ["at", "message"]
_PASSED = T.StructType(
    [
        T.StructField("user_phone", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("level", T.LongType()),
    ]
)


class Bucket:
    """A bucket of ``burst`` tokens that ``rate`` tokens a minute flow into; a message that finds none is throttled.

    Levels are whole numbers, in units of a token's ``MINUTE``-th part, so a
    batch and a stream reckon the same. A throttled message takes nothing.
    """

    def __init__(self, rate: int, burst: int, level: int | None = None, at: int | None = None) -> None:
        self.rate, self.full = rate, burst * MINUTE
        self.level, self.at = self.full if level is None else level, at

    def take(self, at: int) -> bool:
        if self.at is not None:
            self.level = min(self.full, self.level + max(0, at - self.at) * self.rate)
        self.at = at if self.at is None else max(at, self.at)
        if self.level < MINUTE:
            return False
        self.level -= MINUTE
        return True


def _timed(messages: DataFrame) -> DataFrame:
    return messages.select("user_phone", F.col("wa_message_id").cast("string").alias("message"), "wa_received_at", F.unix_millis(F.col("wa_received_at").cast("timestamp")).alias("at"))


def _named(found: DataFrame) -> DataFrame:
    return found.select("user_phone", F.col("message").alias("wa_message_id"), F.timestamp_millis("at").alias("wa_received_at"), "passed", F.floor(F.col("level") / MINUTE).cast("long").alias("tokens"))


def _full_again(rate: int, burst: int) -> int:
    """Milliseconds after which a bucket is full, whatever it held."""
    return -(-burst * MINUTE // rate)


def _stretches(timed: DataFrame, gap: int, bucket: int) -> DataFrame:
    """``stretch``: the moment of the last message before which the user rested for ``gap`` or longer.

    A user's time line is cut into buckets: inside them rows are compared with
    the row before, across them one row for each bucket is.
    """
    rows = timed.withColumn("bucket", F.floor(F.col("at") / bucket))
    inside, across = Window.partitionBy("user_phone", "bucket").orderBy(*_ORDER), Window.partitionBy("user_phone").orderBy("bucket")
    ends = rows.groupBy("user_phone", "bucket").agg(F.max("at").alias("end"))
    ends = ends.withColumn("before", F.lag("end").over(across)).drop("end")
    since = F.col("at") - F.coalesce(F.lag("at").over(inside), F.col("before"))
    begun = rows.join(ends, ["user_phone", "bucket"]).withColumn("begins", F.when(F.coalesce(since >= gap, F.lit(True)), F.col("at")))
    carried = begun.groupBy("user_phone", "bucket").agg(F.max("begins").alias("latest"))
    carried = carried.select("user_phone", "bucket", F.last("latest", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.last("begins", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("own", own).join(carried, ["user_phone", "bucket"]).select("user_phone", "message", "at", F.coalesce("own", "carried").alias("stretch"))


def throttled(messages: DataFrame, rate: int = RATE, burst: int = BURST, bucket_hours: int = 1) -> DataFrame:
    """``user_phone, wa_message_id, wa_received_at, passed, tokens`` (left behind the message) of each message.

    A user's time line is cut where the bucket is surely full: at gaps as long
    as an empty one needs to fill. The stretches between are independent and
    run in parallel, so a busy user is many tasks' work as long as they rest at
    times. Inside a stretch that throttles nothing the closed form holds and
    nothing is walked: the level is what flowed in less what was taken, below
    its running maximum. Rows without a user are one user.
    """
    cut = _stretches(_timed(messages).drop("wa_received_at").withColumn("user_phone", F.coalesce("user_phone", F.lit(""))), _full_again(rate, burst), bucket_hours * 60 * MINUTE)

    stretch = Window.partitionBy("user_phone", "stretch")
    inside = stretch.orderBy(*_ORDER)
    # Before a message: the bucket was full at some earlier one at most, and since then so much flowed in and so many were taken.
    drift = F.col("at") * rate - (F.row_number().over(inside) - 1).cast("long") * MINUTE
    drifted = cut.withColumn("drift", drift)
    level = F.lit(burst * MINUTE) + F.col("drift") - F.max("drift").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    judged = drifted.withColumn("level", level).withColumn("short", F.min("level").over(stretch) < MINUTE)
    easy = judged.filter(~F.col("short")).select("user_phone", "message", "at", F.lit(True).alias("passed"), (F.col("level") - MINUTE).alias("level"))
    dealt = judged.filter("short").select("user_phone", "stretch", "message", "at").repartition("user_phone", "stretch").sortWithinPartitions("user_phone", "stretch", *_ORDER)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bucket = None, None
        for batch in batches:
            passed, levels = [], []
            for user, begun, at in zip(batch["user_phone"], batch["stretch"], batch["at"]):
                if (user, begun) != current:
                    current, bucket = (user, begun), Bucket(rate, burst)
                passed.append(bucket.take(int(at)))
                levels.append(bucket.level)
            yield batch[["user_phone", "message", "at"]].assign(passed=passed, level=levels)

    return _named(easy.unionByName(dealt.mapInPandas(walk, _PASSED)))


class BucketProcessor(StatefulProcessor):
    """A user's bucket as keyed state; one that is full again is forgotten."""

    def __init__(self, rate: int, burst: int) -> None:
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "level bigint, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bucket = Bucket(self.rate, self.burst, *(self.bucket.get() if self.bucket.exists() else (None, None)))
        frame = pd.concat(list(rows)).sort_values(_ORDER)
        passed, levels = [], []
        for at in frame["at"]:
            passed.append(bucket.take(int(at)))
            levels.append(bucket.level)
        self.bucket.update((bucket.level, bucket.at))
        self.handle.registerTimer(bucket.at + _full_again(self.rate, self.burst))
        yield frame[["user_phone", "message", "at"]].assign(passed=passed, level=levels)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.bucket.exists():
            level, at = self.bucket.get()
            if at + _full_again(self.rate, self.burst) <= expiredTimerInfo.getExpiryTimeInMs():
                self.bucket.clear()
        yield pd.DataFrame(columns=_PASSED.names)

    def close(self) -> None:
        pass


def throttled_stream(messages: DataFrame, rate: int = RATE, burst: int = BURST, lateness: str = "10 minutes") -> DataFrame:
    """As ``throttled``, over a stream that brings a user's messages in the order of time."""
    timed = messages.withColumn("wa_received_at", F.col("wa_received_at").cast("timestamp")).withWatermark("wa_received_at", lateness)
    found = _timed(timed).groupBy("user_phone").transformWithStateInPandas(
        statefulProcessor=BucketProcessor(rate, burst), outputStructType=_PASSED, outputMode="Append", timeMode="EventTime"
    )
    return _named(found)
