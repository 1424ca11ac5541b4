"""Line dedup over levelled, sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.llm.common import BLANKS, LOWER, UPPER, fresh_path, text_of

#: Code points a key must have to be judged.
MIN_CHARS = 10
#: Batches that one call cuts a table into, runs that are compacted into one, buckets of a run.
BATCHES, FANOUT, BUCKETS = 4, 2, 16


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _tag() -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64("text").alias("tag")


def judged_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, tag, pos, h1, h2`` of each line whose key is long enough; the two hashes are 128 bits together."""
    lines = docs.select("doc_id", _tag(), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # Short lines go before the key is made: a key is never longer than its line.
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", "tag", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """The line hashes seen so far, as levels of sorted runs.

    A run is a table bucketed and sorted by hash, so that a new batch merges
    with the runs without shuffling them. ``fanout`` runs of one level are
    compacted into one run of the next. Runs hold each hash once, with the
    smallest id of the batch that brought it.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int = BUCKETS):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", fresh_path(self.spark, name)).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a later batch of ``judged_lines``; returns its own new run: ``h1, h2, owner``."""
        new = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            new = new.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        name = self._write(new)
        self.levels[0].append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        """Merge each level that is full into one run of the next level."""
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(merged))
                self.levels[level] = []


def clean_batch(docs: DataFrame, lines: DataFrame, new: DataFrame) -> DataFrame:
    """The batch without lines that an earlier batch or an earlier document holds.

    A line stays where its own document owns the hash in the batch's new run.
    Only hashes and positions meet by hash, where AQE splits a frequent line;
    texts meet their positions by id.
    """
    drops = lines.join(new.hint("merge"), ["h1", "h2"], "left").where(F.col("owner").isNull() | (F.col("owner") < F.col("doc_id")))
    drops = drops.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("drops"))
    # The lines are split before the join, so that the lambda below reads a column and splits nothing again.
    rest = [c for c in docs.columns if c == "rest"]
    joined = docs.select("doc_id", _tag(), F.split("text", "\n").alias("lines"), *rest).join(drops, ["doc_id", "tag"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return joined.select("doc_id", F.array_join(kept, "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), *rest)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, buckets: int = BUCKETS, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: each repeated line stays in its smallest document only.

    The table is taken in batches of ascending id, as it would arrive over
    time: a batch anti-joins the runs, adds its own, and is cleaned against
    what was new in it. ``n_lines`` counts lines before dropping; a null or
    empty text is one empty line. A line that is repeated inside its smallest
    document stays there each time, and goes everywhere else. Rows that share
    an id count as one document. Rows with a null id are one earliest document.
    Empty tables give no row. ``carry`` names columns to return as well, as the
    fields of ``rest``; others are ignored.
    """
    spark = docs.sparkSession
    # A null id joins with nothing, so it gets the smallest number of all.
    earliest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(earliest)).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000).alias("cuts")).head()["cuts"] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    store, cleaned = LineRuns(spark, fanout, buckets), []
    for k in range(len(cuts) + 1):
        batch = rows
        if k:
            batch = batch.where(F.col("doc_id") > cuts[k - 1])
        if k < len(cuts):
            batch = batch.where(F.col("doc_id") <= cuts[k])
        lines = judged_lines(batch, min_chars)
        cleaned.append(clean_batch(batch, lines, store.add(lines)))
        if k < len(cuts):
            store.compact()
    out = cleaned[0]
    for part in cleaned[1:]:
        out = out.unionByName(part)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != earliest, F.col("doc_id")))
