"""What several operators share: white space, the shared folder, a doubling search."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: blank and the five ASCII controls.
BLANKS = " \t\n\x0b\x0c\r"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


class Remembered(dict):
    """Results of ``make`` by key, of a bounded number of keys.

    When ``limit`` keys are held they become the old half, which is asked
    before anything is made again, so that frequent keys are never lost.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def text_of(column: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; only a ``local[...]`` session without that setting gets a scratch one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` as Parquet files in the shared folder; its lineage ends there.

    For jobs of many short steps: the last stage runs once (a checkpoint also
    counts it), and small files are read by few tasks, so the shuffles that
    follow have few parts.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap(slots: DataFrame, bits: int) -> Column:
    """The set slots (0 to ``bits`` - 1) as one array of 64-bit words, a scalar subquery of fixed size."""
    words = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    dense = slots.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")).unionByName(words)
    dense = dense.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("map")).scalar()


def in_bitmap(slot: str, words: str) -> Column:
    """Whether the slot of this row is set; both are columns, the words from ``bitmap``."""
    word = F.try_element_at(words, F.expr(f"cast({slot} div 64 as int) + 1"))
    return F.call_function("shiftright", word, F.expr(f"cast({slot} % 64 as int)")).bitwiseAND(F.lit(1).cast("long")) == 1


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, by halving: a few steps even for a million bounds."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    array = F.array(*map(F.lit, bounds)) if len(bounds) < 4 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(array, at + step) <= value), at + step).otherwise(at),
    )
