"""Running sums of the ledger by tenant, day, category and vendor, kept up to date by batches of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from paperledger.functions.values import day_key
from paperledger.schemas import LOGGED_STATUSES

#: What a sum is of.
KEYS = ["business_id", "day", "category", "vendor", "type"]
#: What is summed; each is a count or a sum of decimals, so that a change can be taken back exactly.
SUMS = ["bills", "valued", "amount", "gst", "auto_logged"]
#: Batches that are merged into one file set at a time.
FANOUT = 16


def _signed(value: Column, sign: Column, kind: str) -> Column:
    return F.sum(F.coalesce(value.cast(kind), F.lit(0).cast(kind)) * sign)


def sums_of(changes: DataFrame) -> DataFrame:
    """The sums that a batch of changes adds: ``sign`` 1 for a bill that is logged, -1 for one that is taken back.

    A correction is both: the bill as it was with -1, as it is with 1. Bills
    that aren't logged or paid count nothing. Combined before the shuffle.
    """
    sign = F.col("sign").cast("int")
    counted = changes.filter(F.col("status").isin(LOGGED_STATUSES)).withColumns(
        {"day": day_key(F.col("confirmed_at")), "category": F.coalesce("category", F.lit("misc")), "type": F.coalesce("type", F.lit("outgoing"))}
    )
    # Whether a category was given doesn't matter to any report; whether an amount was, does.
    return counted.groupBy(*KEYS).agg(
        F.sum(sign.cast("long")).alias("bills"),
        F.sum(F.when(F.col("amount").isNotNull(), sign).otherwise(0).cast("long")).alias("valued"),
        _signed(F.col("amount"), sign, "decimal(28,2)").cast("decimal(38,2)").alias("amount"),
        _signed(F.col("gst"), sign, "decimal(28,2)").cast("decimal(38,2)").alias("gst"),
        F.sum(F.when(F.coalesce("auto_logged", F.lit(False)), sign).otherwise(0).cast("long")).alias("auto_logged"),
    )


def merged(sums: DataFrame) -> DataFrame:
    """Sums added up; keys whose bills were all taken back are gone."""
    return sums.groupBy(*KEYS).agg(*[F.sum(c).cast("decimal(38,2)" if c in ("amount", "gst") else "long").alias(c) for c in SUMS]).filter("bills <> 0 or valued <> 0 or amount <> 0 or gst <> 0 or auto_logged <> 0")


SCHEMA = T.StructType(
    [
        T.StructField("business_id", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in KEYS[1:]],
        *[T.StructField(name, T.DecimalType(38, 2) if name in ("amount", "gst") else T.LongType()) for name in SUMS],
    ]
)


class RunningSums:
    """The sums as levelled sets of files in a shared folder.

    Each batch writes its own sums under its number, and again the same if it
    is repeated, so a batch counts once. When ``fanout`` sets of a level are
    there they are merged into one of the next level; readers take a set only
    if no merged one covers it, so a merge that was cut off is never seen.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT) -> None:
        self.spark, self.folder, self.fanout = spark, folder, fanout

    def _sets(self) -> list[tuple[int, int]]:
        """``level, first batch`` of each whole set, from the markers of finished writes."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = system.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/level=*/batch=*/_SUCCESS")) or []
        names = [str(f.getPath().getParent()) for f in found]
        return [(int(n.split("level=")[1].split("/")[0]), int(n.rsplit("batch=", 1)[1])) for n in names]

    def _span(self, level: int) -> int:
        return self.fanout**level

    def _live(self, sets: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The sets that no larger one covers."""
        have = set(sets)
        top = max((level for level, _ in sets), default=0)
        covered = lambda level, batch: any((up, batch - batch % self._span(up)) in have for up in range(level + 1, top + 1))
        return sorted(x for x in have if not covered(*x))

    def _path(self, level: int, batch: int) -> str:
        return f"{self.folder}/level={level}/batch={batch}"

    def _read(self, sets: list[tuple[int, int]]) -> DataFrame:
        if not sets:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[self._path(*x) for x in sets])

    def add(self, changes: DataFrame, batch: int) -> None:
        """Add batch number ``batch`` (0, 1, ...) and merge the levels that are full."""
        sums_of(changes).select(*SCHEMA.names).write.mode("overwrite").parquet(self._path(0, batch))
        level = 0
        while (batch + 1) % self._span(level + 1) == 0:
            first, step = batch + 1 - self._span(level + 1), self._span(level)
            parts = [(level, first + k * step) for k in range(self.fanout)]
            have = set(self._sets())
            merged(self._read([x for x in parts if x in have])).write.mode("overwrite").parquet(self._path(level + 1, first))
            level += 1

    def sums(self) -> DataFrame:
        """The sums of all batches so far."""
        return merged(self._read(self._live(self._sets())))

    def stream(self, changes: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A writer that adds the batches of a stream of changes."""
        return changes.writeStream.foreachBatch(lambda frame, number: self.add(frame, number)).option("checkpointLocation", checkpoint)


def changes_of_steps(steps: DataFrame) -> DataFrame:
    """Changes from the steps of the draft machine: a logged bill adds, and an undo takes back what its draft last added."""
    order = Window.partitionBy("user_phone", "draft_id").orderBy("at", F.col("event") == "undone")
    kept = ["amount", "gst", "vendor", "auto"]
    decisions = steps.filter(F.col("event").isin("confirmed", "auto_logged", "undone"))
    last = decisions.select("*", F.last(F.when(F.col("event") != "undone", F.struct("at", *kept)), ignorenulls=True).over(order).alias("bill"))
    return last.filter("bill is not null").select(
        "user_phone", "draft_id", F.when(F.col("event") == "undone", -1).otherwise(1).alias("sign"), F.lit("logged").alias("status"), F.col("bill.at").alias("confirmed_at"),
        F.col("bill.amount").cast("decimal(18,2)").alias("amount"), F.col("bill.gst").cast("decimal(18,2)").alias("gst"), F.col("bill.vendor").alias("vendor"), F.col("bill.auto").alias("auto_logged"),
    )


def totals(sums: DataFrame) -> DataFrame:
    """Bills, amounts and taxes over all sums, as the ledger's own totals have them."""
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c)
    return sums.agg(F.coalesce(F.sum("bills"), F.lit(0)).alias("bills"), money("amount"), money("gst"), F.coalesce(F.sum("auto_logged"), F.lit(0)).alias("auto_logged"))


def spend(sums: DataFrame, *by: str) -> DataFrame:
    """Amount and number of bills with an amount, by category, vendor, day or the like; unnamed ones are left out."""
    named = sums.filter(F.col("valued") != 0)
    for c in by:
        named = named.filter(F.col(c).isNotNull())
    return named.groupBy(*by).agg(F.sum("amount").cast("double").alias("amount"), F.sum("valued").alias("bills"))


def options(sums: DataFrame) -> DataFrame:
    """``kind, value``: the months, categories and vendors there are to choose from, without a look at the ledger."""
    rows = F.array(
        F.struct(F.lit("month").alias("kind"), F.substring("day", 1, 7).alias("value")),
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        F.struct(F.lit("vendor").alias("kind"), F.col("vendor").alias("value")),
    )
    return sums.filter("bills > 0").select(F.explode(rows).alias("x")).select("x.*").filter("value is not null").distinct()
