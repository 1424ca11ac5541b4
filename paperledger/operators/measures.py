"""Medians and numbers of different values: exact without a list per group, and as sketches that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperledger.plans.lineage import cut_lineage

#: Bits of a value that one pass of the exact median decides.
STEP = 16


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys, ``n`` and ``median`` (double) of a whole-number column, nulls aside; a group without values has no row.

    The median is narrowed down by histograms: a pass counts the values by
    their leading bits, and only those that share the bits of the middle ones
    go on to the next. Rows are counted before they are shuffled, and a group
    is never more than 65,536 counts at a time, however many rows it has.
    """
    values = rows.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias("key"), F.col(value).cast("long").alias("value"))
    totals = values.groupBy("key").agg(F.count("*").alias("n"))
    middles = F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))
    sought = totals.select("key", F.posexplode(middles).alias("which", "rank"), F.lit(0).cast("long").alias("lead"))
    left = values.withColumn("lead", F.lit(0).cast("long"))
    for shift in range(64 - STEP, -1, -STEP):
        # Shifting keeps the sign, so leading bits are in the order of the values.
        counts = left.groupBy("key", "lead", F.shiftright("value", shift).alias("next")).agg(F.count("*").alias("count"))
        line = Window.partitionBy("key", "lead").orderBy("next")
        start = F.sum("count").over(line) - F.col("count")
        found = counts.withColumn("start", start).join(sought, ["key", "lead"]).filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("count")))
        # Two rows for each group; without the cut every pass would hold the plans of all before it twice.
        sought = cut_lineage(found.select("key", "which", (F.col("rank") - F.col("start")).alias("rank"), F.col("next").alias("lead")))
        if shift:
            left = values.withColumn("lead", F.shiftright("value", shift)).join(sought.select("key", "lead").distinct(), ["key", "lead"], "left_semi")
    middle = sought.groupBy("key").agg(F.avg("lead").alias("median"))
    return totals.join(middle, "key").select("key.*", "n", "median")


def exact_distinct(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys and ``different``, in two steps that both combine before the shuffle; nulls aside."""
    pairs = rows.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    return pairs.groupBy(*keys).agg(F.count("*").alias("different"))


def sketches(rows: DataFrame, keys: list[str], value: str, member: str) -> DataFrame:
    """The keys, ``n``, ``values`` (a quantile sketch of ``value``) and ``members`` (a distinct sketch of ``member``).

    Kept by day, they are merged to weeks or any other spans without the rows.
    """
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.kll_sketch_agg_bigint(F.col(value).cast("long")).alias("values"),
        F.hll_sketch_agg(F.col(member), F.lit(14)).alias("members"),
    )


def merged_sketches(kept: DataFrame, *by: Column) -> DataFrame:
    """Sketches merged over the given columns, with what they show: ``median`` and ``different``, both near.

    The rank of the median is off by about 1.4 % of the rows at most, the
    number of different members by about 2 %.
    """
    whole = kept.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("values").alias("values"), F.hll_union_agg("members").alias("members"))
    return whole.withColumns({"median": F.kll_sketch_get_quantile_bigint("values", F.lit(0.5)), "different": F.hll_sketch_estimate("members")})
