"""Reports the product description asks for: summaries, search, tax, alerts, KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperledger.operators.analytics import _money, category_name, logged
from paperledger.functions.values import day_key, month_key


def daily_summary(bills: DataFrame, members: DataFrame, zones: DataFrame) -> DataFrame:
    """Per viewer, local day, direction and category; owners see the whole business.

    Bills are summed per user first. Owner rows come from those sums, so a bill
    is never repeated once per viewer.
    """
    local = F.to_date(F.from_utc_timestamp(F.col("confirmed_at").cast("timestamp"), F.col("timezone")))
    keys = ["business_id", "day", "type", "category"]
    sums = (
        logged(bills)
        .join(zones, "business_id")
        .select("business_id", "user_id", local.alias("day"), "type", category_name().alias("category"), "amount")
        .groupBy("user_id", *keys)
        .agg(F.count("*").alias("bills"), F.sum("amount").alias("amount"))
    )
    owners = members.filter("role = 'owner'").select("business_id", F.col("user_id").alias("viewer"))
    staff = members.filter("role = 'staff'").select("business_id", "user_id")
    whole = sums.groupBy(*keys).agg(F.sum("bills").alias("bills"), F.sum("amount").alias("amount"))
    seen = whole.join(owners, "business_id").unionByName(
        sums.join(staff, ["business_id", "user_id"]).withColumnRenamed("user_id", "viewer")
    )
    return seen.select("viewer", "business_id", day_key(F.col("day")).alias("day"), "type", "category", "bills", _money(F.col("amount")).alias("amount"))


def daily_net(summary: DataFrame) -> DataFrame:
    """Incoming, outgoing and net per viewer and day."""
    flow = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("amount").cast("decimal(38,2)"))), F.lit(0))
    sums = summary.groupBy("viewer", "business_id", "day").agg(flow("incoming").alias("i"), flow("outgoing").alias("o"))
    return sums.select(
        "viewer",
        "business_id",
        "day",
        F.col("i").cast("double").alias("incoming"),
        F.col("o").cast("double").alias("outgoing"),
        (F.col("i") - F.col("o")).cast("double").alias("net"),
    )


def _fits(w: str) -> Column:
    """Whether vendor (one letter may be wrong), category, month or amount of a bill is ``w``."""
    vendor = F.coalesce(F.lower("vendor"), F.lit(""))
    near = F.exists(F.split(vendor, r"\s+"), lambda x: F.levenshtein(x, F.lit(w), 1) >= 0)
    month = F.lower(F.date_format("confirmed_at", "MMMM")) == w
    hit = F.contains(vendor, F.lit(w)) | near | (category_name() == w) | month | (month_key(F.col("confirmed_at")) == w)
    try:
        return hit | F.coalesce(F.col("amount") == float(w.lstrip("$").replace(",", "")), F.lit(False))
    except ValueError:
        return hit


def search(bills: DataFrame, words: str, user: str = "user_id", n: int = 5) -> DataFrame:
    """Newest bills per user that each of the words fits; a leading ``find`` or ``show`` is the command."""
    asked = words.strip().lower().split()
    asked = asked[1:] if asked[:1] in (["find"], ["show"]) else asked
    hit = F.lit(True)
    for w in asked:
        hit = hit & _fits(w)
    order = Window.partitionBy(user).orderBy(F.desc("confirmed_at"), F.desc("bill_id"))
    found = logged(bills).filter(hit).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return found.filter(F.col("rank") <= n)


def tax_quarters(bills: DataFrame, party: str = "vendor") -> DataFrame:
    """Tax collected and paid per business, quarter and party, with quarter totals."""
    quarter = F.concat(F.year("confirmed_at").cast("string"), F.lit("-Q"), F.quarter("confirmed_at").cast("string"))
    flow = lambda t: _money(F.sum(F.when(F.col("type") == t, F.col("gst"))))
    base = logged(bills).filter("gst is not null").withColumn("quarter", quarter)
    # A party without a name must not look like the total row.
    base = base.withColumn("party", F.coalesce(party, F.lit("unknown")))
    sums = base.groupingSets(
        [["business_id", "quarter", "party"], ["business_id", "quarter"]], "business_id", "quarter", "party"
    ).agg(flow("incoming").alias("collected"), flow("outgoing").alias("paid"), F.count("*").alias("bills"))
    return sums.select("business_id", "quarter", F.coalesce("party", F.lit("all")).alias("party"), "collected", "paid", "bills")


def due_alerts(bills: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """Unpaid bills due within ``days``, and those already overdue."""
    today = as_of.cast("date")
    open_bill = F.col("status") == "logged"
    near = bills.filter(open_bill & (F.col("due_date") <= F.date_add(today, days)))
    return near.withColumn("alert", F.when(F.col("due_date") < today, "overdue").otherwise("due_soon"))


PERIODS = {"weekly": "7 days", "fortnightly": "14 days", "monthly": "1 month", "quarterly": "3 months", "yearly": "1 year"}


def expand_recurring(rules: DataFrame, until: Column) -> DataFrame:
    """Dated payments of rules from their first day on; a rule without ``period`` is monthly.

    A payment's id names its rule and day (its month, where there is one in a
    month at most), so that it is the same however often rules are expanded.
    """
    if "period" not in rules.columns:
        rules = rules.withColumn("period", F.lit("monthly"))
    first, last, period = F.col("first_day").cast("date"), until.cast("date"), F.coalesce("period", F.lit("monthly"))
    days = F.lit(None).cast("array<date>")
    for name, step in PERIODS.items():
        days = F.when(period == name, F.sequence(first, last, F.expr(f"interval {step}"))).otherwise(days)
    # A few files of rules are many payments, so they are dealt out before they are expanded.
    started = rules.filter(first <= last).select("rule_id", "user_id", "vendor", "amount", "first_day", "period").repartition("rule_id")
    shape = F.when(F.col("period").isin("weekly", "fortnightly"), F.date_format("pay_day", "yyyy-MM-dd")).otherwise(F.date_format("pay_day", "yyyy-MM"))
    return started.select("rule_id", "user_id", "vendor", "amount", period.alias("period"), F.explode(days).alias("pay_day")).select(
        F.concat_ws("/", F.lit("rule"), F.col("rule_id").cast("string"), shape).alias("payment_id"),
        "rule_id",
        "user_id",
        "vendor",
        "amount",
        day_key(F.col("pay_day")).alias("pay_day"),
    )


def due_payments(payments: DataFrame, posted: DataFrame) -> DataFrame:
    """Payments that were not posted before; ``posted`` has their ``payment_id``.

    What was posted grows with the payments, while its source may be a small
    table: the planner would take its size from that and broadcast it.
    """
    return payments.join(posted.select("payment_id").hint("merge"), "payment_id", "left_anti")


def cash_flow(bills: DataFrame, first: Column, last: Column) -> DataFrame:
    """Incoming and outgoing money per day, zero-filled."""
    day = F.to_date("confirmed_at")
    inside = logged(bills).filter((day >= first.cast("date")) & (day <= last.cast("date")))
    sums = inside.groupBy(day.alias("day")).pivot("type", ["incoming", "outgoing"]).agg(F.sum("amount"))
    spine = bills.sparkSession.range(1).select(F.explode(F.sequence(first.cast("date"), last.cast("date"))).alias("day"))
    joined = spine.join(sums, "day", "left")
    return joined.select(day_key(F.col("day")).alias("day"), _money(F.col("incoming")).alias("incoming"), _money(F.col("outgoing")).alias("outgoing"))


def kpis(bills: DataFrame) -> DataFrame:
    """Shares, activity and median time to log per week.

    Expects ``created_at`` (photo sent) and ``confirmed_at`` (logged).
    """
    done = F.col("status").isin("logged", "paid", "deleted")
    seconds = F.unix_seconds(F.col("confirmed_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    week = day_key(F.date_trunc("week", "confirmed_at"))
    n, users = F.count("*"), F.count_distinct("user_phone")
    return bills.filter(done).groupBy(week.alias("week")).agg(
        n.alias("bills"),
        (F.count_if("auto_logged") / n).alias("auto_log_rate"),
        (F.count_if(F.col("status") == "deleted") / n).alias("undo_rate"),
        users.alias("users"),
        (n / users).alias("bills_per_user"),
        F.percentile(seconds, F.lit(0.5)).alias("median_seconds"),
    )


def daily_users(messages: DataFrame) -> DataFrame:
    day = day_key(F.col("wa_received_at")).alias("day")
    return messages.groupBy(day).agg(F.count_distinct("user_phone").alias("users"))


def queue_images(messages: DataFrame) -> DataFrame:
    """One draft per image of a message: the first is active, the others wait."""
    spread = messages.select("user_phone", "wa_message_id", "created_at", F.posexplode("image_urls").alias("pos", "image_url"))
    state = F.when(F.col("pos") == 0, "awaiting_confirm").otherwise("queued")
    return spread.withColumn("pos", F.col("pos").cast("bigint")).withColumn("flow_state", state)


def visible_bills(bills: DataFrame, members: DataFrame) -> DataFrame:
    """Bill ids each member may read: own rows, or the whole business for owners."""
    owners = members.filter("role = 'owner'").select("business_id", F.col("user_id").alias("viewer"))
    own = bills.select("business_id", F.col("user_id").alias("viewer"), "bill_id")
    # Owners already get their own rows with the rest of the business.
    other = own.join(owners, ["business_id", "viewer"], "left_anti")
    return bills.select("business_id", "bill_id").join(owners, "business_id").unionByName(other)


def bills_of_viewer(bills: DataFrame, members: DataFrame, viewer: Column) -> DataFrame:
    """The rows that one member may read, each once: those of the businesses owned, and the viewer's own.

    The member's businesses are found first and prune the ledger; no bill is
    repeated for anyone else.
    """
    owned = members.filter((F.col("role") == "owner") & (F.col("user_id") == viewer)).select("business_id", F.lit(True).alias("owned")).distinct()
    joined = bills.join(owned, "business_id", "left")
    return joined.filter(F.coalesce("owned", F.lit(False)) | (F.col("user_id") == viewer)).select(*bills.columns)


def shared_bills(bills: DataFrame, links: DataFrame, token: str, as_of: Column) -> DataFrame:
    """Bills of the one business a live share link opens."""
    live = links.filter((F.col("token") == token) & (F.col("expires_at") > as_of)).select("business_id")
    return bills.join(live, "business_id", "left_semi")
