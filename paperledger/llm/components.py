"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import stored


def _sorted_pairs(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``u, v`` links to ``node, root``: each node but the root itself, with the smallest node it reaches.

    Each round hangs larger neighbours on the smallest one (large star), then
    smaller neighbours (small star); the minima are pre-aggregated before the
    shuffle and a node with very many links is a skewed join, which AQE splits.
    A round is written to the shared folder, so a lost executor costs one round.
    Ends when a round changes nothing; the number of rounds grows with the
    logarithm of the nodes.
    """
    stars = stored(_sorted_pairs(links))
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stored(_sorted_pairs(small.unionByName(lowest.select("u", F.col("m").alias("v")))))
        now = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).head()
        if now == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
