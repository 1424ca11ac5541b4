"""Ledger analytics: scoped totals, rankings, daily series and the accountant extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperledger.functions.values import day_key, month_key
from paperledger.schemas import LOGGED_STATUSES


def category_name() -> Column:
    return F.coalesce(F.col("category"), F.lit("misc"))


def logged(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status").isin(LOGGED_STATUSES))


def newest_per_user(ledger: DataFrame, limit: int | None = None, user: str = "user_id") -> DataFrame:
    """Logged bills, of each user the newest ``limit`` with their rank; ``None`` keeps the whole history."""
    order = Window.partitionBy(user).orderBy(F.desc("confirmed_at"), F.desc("bill_id"))
    if limit is None:
        return logged(ledger)
    # The rank filter is applied before the shuffle as well as after it.
    return logged(ledger).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def recent_logged(ledger: DataFrame, since: Column, user: str = "user_id") -> DataFrame:
    """The newest logged bill per user since a point in time."""
    newest = F.max_by(F.struct("bill_id", "confirmed_at"), F.struct("confirmed_at", "bill_id"))
    found = logged(ledger).filter(F.col("confirmed_at") >= since).groupBy(user).agg(newest.alias("n"))
    return found.select(user, "n.bill_id", "n.confirmed_at")


def scope(bills: DataFrame, month: str | None = None, category: str | None = None, vendor: str | None = None) -> DataFrame:
    """Cascading filter; a value that does not occur at its level is ignored.

    One aggregate pass finds which values occur, and its single row is joined to
    the bills, so nothing is collected to the driver.
    """
    checks = []
    if month:
        first = F.to_timestamp(F.lit(f"{month}-01"))
        checks.append(("month", (F.col("confirmed_at") >= first) & (F.col("confirmed_at") < F.add_months(first, 1).cast("timestamp"))))
    if category:
        checks.append(("category", category_name() == category))
    if vendor:
        checks.append(("vendor", F.col("vendor") == vendor))
    if not checks:
        return bills
    # One flag per subset of levels: does any row satisfy exactly these checks?
    flags = []
    for mask in range(1, 1 << len(checks)):
        both = F.lit(True)
        for i, (_, check) in enumerate(checks):
            if mask >> i & 1:
                both = both & F.coalesce(check, F.lit(False))
        flags.append(F.coalesce(F.bool_or(both), F.lit(False)).alias(f"has_{mask}"))
    row = bills.agg(*flags)
    active: list[Column] = []
    for level in range(len(checks)):
        found = F.lit(False)
        for mask in range(1 << level):
            chosen = F.lit(True)
            for i in range(level):
                chosen = chosen & (active[i] if mask >> i & 1 else ~active[i])
            found = found | (chosen & F.col(f"has_{mask | 1 << level}"))
        active.append(found)
    keep = F.lit(True)
    for (_, check), used in zip(checks, active):
        keep = keep & (~used | F.coalesce(check, F.lit(False)))
    return bills.crossJoin(F.broadcast(row)).filter(keep).select(*bills.columns)


def _money(total: Column) -> Column:
    return F.coalesce(total, F.lit(0)).cast("double")


def totals(bills: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    auto = F.count_if("auto_logged")
    return bills.groupBy(*by).agg(
        F.count("*").alias("bills"),
        _money(F.sum("amount")).alias("amount"),
        _money(F.sum("gst")).alias("gst"),
        auto.alias("auto_logged"),
        (F.count("*") - auto).alias("manual"),
    )


def by_category(bills: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    priced = bills.filter("amount is not null").groupBy(*by, category_name().alias("category"))
    sums = priced.agg(F.count("*").alias("bills"), _money(F.sum("amount")).alias("amount"))
    return sums.orderBy(*by, F.desc("amount"), "category")


def top_vendors(bills: DataFrame, n: int = 8) -> DataFrame:
    return _by_vendor(bills).orderBy(F.desc("amount"), "vendor").limit(n)


def top_vendors_by(bills: DataFrame, tenant: str, n: int = 8) -> DataFrame:
    order = Window.partitionBy(tenant).orderBy(F.desc("amount"), "vendor")
    return _by_vendor(bills, (tenant,)).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n)


def _by_vendor(bills: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    priced = bills.filter("amount is not null and vendor is not null")
    return priced.groupBy(*by, "vendor").agg(
        F.count("*").alias("bills"), _money(F.sum("amount")).alias("amount")
    )


def _spine(bills: DataFrame, first: Column, last: Column) -> DataFrame:
    spark = bills.sparkSession
    days = F.explode(F.sequence(first.cast("date"), last.cast("date"))).alias("day")
    return spark.range(1).select(days)


def per_day(bills: DataFrame, first: Column, last: Column) -> DataFrame:
    """Zero-filled daily series between two days, both included."""
    day = F.to_date("confirmed_at")
    inside = bills.filter((day >= first.cast("date")) & (day <= last.cast("date")))
    sums = inside.groupBy(day.alias("day")).agg(F.count("*").alias("bills"), F.sum("amount").alias("amount"))
    return (
        _spine(bills, first, last)
        .join(sums, "day", "left")
        .select(
            day_key(F.col("day")).alias("day"),
            F.coalesce("bills", F.lit(0)).cast("bigint").alias("bills"),
            _money(F.col("amount")).alias("amount"),
        )
        .orderBy("day")
    )


def last_days(bills: DataFrame, as_of: Column, n: int = 7) -> DataFrame:
    return per_day(bills, F.date_sub(as_of.cast("date"), n - 1), as_of)


def month_days(bills: DataFrame, month: str) -> DataFrame:
    first = F.to_date(F.lit(f"{month}-01"))
    return per_day(bills, first, F.last_day(first))


def month_options(bills: DataFrame) -> DataFrame:
    months = bills.select(month_key(F.col("confirmed_at")).alias("month"))
    return months.filter("month is not null").distinct().orderBy(F.desc("month"))


def category_options(bills: DataFrame) -> DataFrame:
    return bills.select(category_name().alias("category")).distinct().orderBy("category")


def vendor_options(bills: DataFrame) -> DataFrame:
    return bills.select("vendor").filter("vendor is not null").distinct().orderBy("vendor")


def recent(bills: DataFrame, n: int = 20) -> DataFrame:
    return bills.orderBy(F.desc("confirmed_at"), F.desc("bill_id")).limit(n)


def flatten_draft(drafts: DataFrame) -> DataFrame:
    """Logged drafts with their extraction struct as flat report columns."""
    e = F.col("raw_extraction")
    return drafts.select(
        F.col("id").alias("bill_id"),
        F.coalesce("confirmed_at", "created_at").alias("confirmed_at"),
        e["date"]["value"].alias("date"),
        e["vendor"]["value"].alias("vendor"),
        e["vendor_resolved_to"]["value"].alias("vendor_resolved_to"),
        F.coalesce(e["category_hint"]["value"], F.lit("misc")).alias("category"),
        e["amount"]["value"].alias("amount"),
        e["gst"]["value"].alias("gst"),
        e["gst_basis"].alias("gst_basis"),
        e["invoice_number"]["value"].alias("invoice_number"),
        e["abn"]["value"].alias("abn"),
        F.coalesce("auto_logged", F.lit(False)).alias("auto_logged"),
        "gate_level",
    )
