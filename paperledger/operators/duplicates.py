"""The duplicate gate: an earlier logged bill of the same user within 90 days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperledger.config import DEFAULTS, Settings
from paperledger.schemas import LOGGED_STATUSES


def latest_before(
    df: DataFrame, keys: list[Column], ts: str, row_id: str, eligible: Column, into: str, bucket: str = "hour"
) -> DataFrame:
    """Add ``into``: the last eligible earlier row of the same key as struct(ts, id).

    No pairs are built. Each key is cut into time buckets, looked up inside the
    bucket with a window, and across buckets from one pre-aggregated row per
    bucket, so a key that holds a large share of all rows spreads over many tasks.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    at = F.when(eligible, F.struct(F.col(ts).alias("ts"), F.col(row_id).alias("id")))
    keyed = df.select(
        "*", *[k.alias(n) for k, n in zip(keys, names)], F.date_trunc(bucket, ts).alias("__b"), at.alias("__at")
    )
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy(*names, "__b").orderBy(ts, row_id))
    across = before(Window.partitionBy(*names).orderBy("__b"))
    carried = (
        keyed.groupBy(*names, "__b")
        .agg(F.max("__at").alias("__top"))
        .select(*names, "__b", F.last("__top", ignorenulls=True).over(across).alias("__carry"))
        .filter("__carry is not null")
    )
    scanned = keyed.withColumn("__in", F.last("__at", ignorenulls=True).over(inside))
    left, right = scanned.alias("l"), carried.alias("r")
    same = [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in [*names, "__b"]]
    joined = left.join(right, same, "left")
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns], F.coalesce("l.__in", "r.__carry").alias(into)
    )


def find_duplicates(
    bills: DataFrame, user: str = "user_id", settings: Settings = DEFAULTS, bucket: str = "hour"
) -> DataFrame:
    """Add ``duplicate_of`` and ``matched_on`` (``invoice`` wins over ``vendor_amount``)."""
    eligible = F.col("status").isin(LOGGED_STATUSES)
    # A missing key must match nothing: it becomes a group of its own.
    lone = lambda missing: F.when(missing, F.col("bill_id"))
    no_invoice = F.col(user).isNull() | F.col("invoice_number").isNull()
    no_pair = F.col(user).isNull() | F.col("vendor").isNull() | F.col("amount").isNull()
    out = latest_before(
        bills, [F.col(user), F.col("invoice_number"), lone(no_invoice)], "confirmed_at", "bill_id", eligible, "__inv", bucket
    )
    out = latest_before(
        out, [F.col(user), F.col("vendor"), F.col("amount"), lone(no_pair)], "confirmed_at", "bill_id", eligible, "__pair", bucket
    )
    oldest = F.col("confirmed_at") - F.make_dt_interval(F.lit(settings.duplicate_days))
    recent = lambda c: F.col(f"{c}.ts") >= oldest
    return out.select(
        *bills.columns,
        F.when(recent("__inv"), F.col("__inv.id")).when(recent("__pair"), F.col("__pair.id")).alias("duplicate_of"),
        F.when(recent("__inv"), "invoice").when(recent("__pair"), "vendor_amount").alias("matched_on"),
    )


def same_bill(previous: dict[str, Column], candidate: dict[str, Column]) -> Column:
    """The matching rule on its own: invoice, or vendor and amount."""
    invoice = previous["invoice_number"] == candidate["invoice_number"]
    pair = (previous["vendor"] == candidate["vendor"]) & (previous["amount"] == candidate["amount"])
    return F.coalesce(invoice, F.lit(False)) | F.coalesce(pair, F.lit(False))


def audit_pairs(bills: DataFrame, partner: str = "duplicate_of") -> DataFrame:
    """Each named pair once, with whether the rule would match it either way.

    A pair whose partner does not exist has ``known`` false.
    """
    fields = ["invoice_number", "vendor", "amount"]
    low, high = F.least("bill_id", partner), F.greatest("bill_id", partner)
    pairs = bills.filter(F.col(partner).isNotNull()).select(low.alias("a"), high.alias("b")).distinct()
    side = lambda s: bills.select(
        F.col("bill_id").alias(s), *[F.col(f).alias(f"{s}_{f}") for f in fields], F.lit(True).alias(f"{s}_known")
    )
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    left = {f: F.col(f"a_{f}") for f in fields}
    right = {f: F.col(f"b_{f}") for f in fields}
    return both.select(
        "a",
        "b",
        F.coalesce(F.col("a_known") & F.col("b_known"), F.lit(False)).alias("known"),
        (same_bill(left, right) | same_bill(right, left)).alias("matches"),
    )


def auto_log(bills: DataFrame) -> DataFrame:
    """Add ``auto_log``: graded high, from the trusted reader, allowed and no copy."""
    allowed = F.coalesce("auto_save", F.lit(True))
    decided = (F.col("gate") == "high") & ~F.col("machine_read") & allowed & F.col("duplicate_of").isNull()
    return bills.withColumn("auto_log", decided)
