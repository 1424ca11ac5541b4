"""Bill data as views over the given tables, in Spark and as SQL text.

Every registered query reads these, so its work grows with the tables. The SQL
twins are the same definitions for the cross-check engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.functions.values import compute_gst


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("vendor"))
    return lines.agg(F.min("l_partkey").alias("p_partkey")).join(parts, "p_partkey", "left").drop("p_partkey")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bill per order. Some amounts and categories are missing on purpose."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("business_id")
    )
    key = F.col("o_orderkey")
    basis = F.when(key % 3 == 0, "inclusive").when(key % 3 == 1, "exclusive").otherwise("none")
    known = key % 50 != 0
    bills = orders.select(
        key,
        "o_custkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", "wages")
        .when(F.col("o_orderpriority") == "2-HIGH", "utilities")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "inventory")
        .when(F.col("o_orderpriority") == "5-LOW", "rent")
        .alias("category"),
        F.when(known, F.col("o_totalprice")).alias("price"),
        basis.alias("gst_basis"),
        F.when(F.col("o_orderstatus") == "F", "logged")
        .when(F.col("o_orderstatus") == "P", "paid")
        .otherwise("draft")
        .alias("status"),
        (key % 2 == 0).alias("auto_logged"),
        F.when(key % 5 == 0, "incoming").otherwise("outgoing").alias("type"),
        F.col("o_orderdate").alias("confirmed_at"),
    )
    return (
        bills.join(customers, "o_custkey")
        .join(_first_part(spark, sf_dir), "o_orderkey", "left")
        .select(
            key.alias("bill_id"),
            F.col("o_custkey").alias("user_id"),
            "business_id",
            "vendor",
            "category",
            F.col("price").cast("decimal(18,2)").alias("amount"),
            compute_gst(F.col("price"), F.col("gst_basis"), F.lit(True)).cast("decimal(18,2)").alias("gst"),
            "gst_basis",
            "status",
            "auto_logged",
            "type",
            "confirmed_at",
        )
    )


LEDGER_SQL = """
first_part as (select l_orderkey, min(l_partkey) as partkey from lineitem group by l_orderkey),
ledger as (
  select o_orderkey as bill_id, o_custkey as user_id, cast(c_nationkey as bigint) as business_id, p_name as vendor,
    case o_orderpriority when '1-URGENT' then 'wages' when '2-HIGH' then 'utilities'
      when '3-MEDIUM' then 'inventory' when '5-LOW' then 'rent' end as category,
    case when o_orderkey % 50 <> 0 then cast(o_totalprice as decimal(18,2)) end as amount,
    case when o_orderkey % 50 <> 0 then cast(case o_orderkey % 3
      when 0 then floor((o_totalprice / 11 + 2.220446049250313e-16) * 100 + 0.5) / 100
      when 1 then floor((o_totalprice * 0.1::double + 2.220446049250313e-16) * 100 + 0.5) / 100 end as decimal(18,2)) end as gst,
    case o_orderkey % 3 when 0 then 'inclusive' when 1 then 'exclusive' else 'none' end as gst_basis,
    case o_orderstatus when 'F' then 'logged' when 'P' then 'paid' else 'draft' end as status,
    o_orderkey % 2 = 0 as auto_logged,
    case when o_orderkey % 5 = 0 then 'incoming' else 'outgoing' end as type,
    o_orderdate as confirmed_at
  from orders join customer on c_custkey = o_custkey
    left join first_part on l_orderkey = o_orderkey left join part on p_partkey = partkey),
logged as (select * from ledger where status in ('logged', 'paid'))
"""


def dup_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with coarse amounts and few invoice numbers, so that copies occur."""
    key = F.col("bill_id")
    return ledger(spark, sf_dir).select(
        key,
        "user_id",
        "vendor",
        "status",
        "confirmed_at",
        (F.floor(F.col("amount") / 100000) * 100000).cast("bigint").alias("amount"),
        F.when(key % 3 == 0, F.concat(F.lit("INV-"), (key % 20).cast("string"))).alias("invoice_number"),
        "auto_logged",
    )


DUP_SQL = (
    LEDGER_SQL
    + """,
dup_ledger as (select bill_id, user_id, vendor, status, confirmed_at,
    cast(floor(amount / 100000) * 100000 as bigint) as amount,
    case when bill_id % 3 = 0 then 'INV-' || (bill_id % 20) end as invoice_number, auto_logged from ledger)
"""
)


def bill_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill text with known truth, composed from the ledger."""
    bills = ledger(spark, sf_dir).filter("amount is not null")
    amount = F.col("amount").cast("double")
    basis = F.col("gst_basis")
    # Every third name is misread: capital I as lower-case l.
    shown = F.when(F.col("bill_id") % 3 == 0, F.translate(F.upper("vendor"), "I", "l")).otherwise(F.upper("vendor"))
    return bills.select(
        "bill_id",
        "user_id",
        F.upper("vendor").alias("vendor"),
        amount.alias("amount"),
        F.date_format("confirmed_at", "yyyy-MM-dd").alias("date"),
        basis.alias("gst_basis"),
        F.col("gst").cast("double").alias("gst"),
        F.concat_ws(
            "\n",
            shown,
            F.concat(F.lit("Date: "), F.date_format("confirmed_at", "dd/MM/yyyy")),
            F.format_string("Subtotal: $%.2f", F.floor(amount * F.lit(0.9)).cast("double")),
            F.format_string("Total: $%.2f", amount),
            F.when(basis == "inclusive", "GST inclusive").when(basis == "exclusive", "plus GST"),
        ).alias("text"),
    )


TEXT_SQL = (
    LEDGER_SQL
    + """,
bill_text as (select bill_id, user_id, upper(vendor) as vendor, cast(amount as double) as amount,
    strftime(confirmed_at, '%Y-%m-%d') as date, gst_basis, cast(gst as double) as gst,
    -- What the rules read as vendor: the first line, or a lone word left over.
    case when vendor is null then case when gst_basis = 'exclusive' then 'plus' end
      when bill_id % 3 = 0 then translate(upper(vendor), 'I', 'l') else upper(vendor) end as read_vendor,
    concat_ws(chr(10), case when bill_id % 3 = 0 then translate(upper(vendor), 'I', 'l') else upper(vendor) end,
      'Date: ' || strftime(confirmed_at, '%d/%m/%Y'),
      printf('Subtotal: $%.2f', cast(floor(cast(amount as double) * 0.9::double) as double)),
      printf('Total: $%.2f', cast(amount as double)),
      case gst_basis when 'inclusive' then 'GST inclusive' when 'exclusive' then 'plus GST' end) as text
  from ledger where amount is not null)
"""
)


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draft per event, in every flow state."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("user_phone"),
        F.concat(F.lit("m"), (F.col("event_id") % 4000).cast("string")).alias("wa_message_id"),
        F.when(kind == "purchase", "awaiting_confirm")
        .when(kind == "click", "editing_amount")
        .when(kind == "view", "processing")
        .when(kind == "signup", "queued")
        .otherwise("editing_date")
        .alias("flow_state"),
        F.when(kind == "error", "expired").otherwise("draft").alias("status"),
        F.col("value").alias("amount"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("interval 10 minutes")).alias("flow_expires_at"),
        F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("interval 6 minutes")).alias("flow_nudged_at"),
    )


DRAFTS_SQL = """
drafts as (select event_id as id, cast(user_id as varchar) as user_phone, 'm' || (event_id % 4000) as wa_message_id,
    case event_type when 'purchase' then 'awaiting_confirm' when 'click' then 'editing_amount'
      when 'view' then 'processing' when 'signup' then 'queued' else 'editing_date' end as flow_state,
    case event_type when 'error' then 'expired' else 'draft' end as status, value as amount,
    ts as created_at, ts + interval 10 minute as flow_expires_at,
    case when event_id % 7 = 0 then ts + interval 6 minute end as flow_nudged_at from events)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw message payloads as JSON text, one per event, some of them unusable."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat(
            F.lit('{"entry":[{"changes":[{"value":{"messages":[{"from":"'),
            F.col("user_id").cast("string"),
            F.lit('","id":"m'),
            F.col("event_id").cast("string"),
            F.lit('","timestamp":"'),
            F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"),
            F.lit('",'),
            _payload(F.col("event_type"), F.col("event_id").cast("string"), F.col("value").cast("string")),
            F.lit("}]}}]}]}"),
        ).alias("raw"),
    )


def _payload(kind: Column, event_id: Column, value: Column) -> Column:
    return (
        F.when(kind == "purchase", F.concat(F.lit('"type":"image","image":{"id":"p'), event_id, F.lit('"}')))
        .when(kind == "click", F.lit('"type":"text","text":{"body":"1"}'))
        .when(kind == "view", F.concat(F.lit('"type":"text","text":{"body":"pay '), value, F.lit('"}')))
        .when(kind == "signup", F.lit('"type":"audio"'))
        .otherwise(F.lit('"type":"text","text":{"body":null}'))
    )


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised messages, one per event, for the draft life cycle.

    Photos carry a graded reading; texts are replies and commands.
    """
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    key = F.col("event_id")
    photo = kind == "purchase"
    # Events are minutes apart per user; an hour of the stream becomes a minute
    # so that replies reach drafts that are still open.
    # Every third photo is sent again, after half a minute or after nine.
    later = F.when(photo & (key % 3 == 0), F.array(F.lit(0), F.when(key % 2 == 0, 30).otherwise(540))).otherwise(F.array(F.lit(0)))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seconds = (F.col("ts").cast("timestamp").cast("double") - start.cast("double")) / 240
    return e.withColumn("later", F.explode(later)).select(
        F.col("user_id").cast("string").alias("user_phone"),
        key.cast("string").alias("wa_message_id"),
        F.timestamp_micros((start.cast("double") * 1000000 + F.floor((seconds + F.col("later")) * 1000000)).cast("bigint")).alias("wa_received_at"),
        F.when(photo, "photo").otherwise("text").alias("kind"),
        F.when(kind == "click", "1")
        .when(kind == "error", "delete")
        .when(kind == "view", F.element_at(F.array(*[F.lit(x) for x in ("2", "3", "4", "5", "$12.50", "hello")]), (key % 6 + 1).cast("int")))
        .when(kind == "signup", "help")
        .alias("text"),
        F.when(photo, F.col("value")).alias("amount"),
        F.when(photo & (key % 2 == 0), F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.when(photo, F.concat(F.lit("vendor "), (key % 9).cast("string"))).alias("vendor"),
        (photo & (key % 3 == 0)).alias("machine_read"),
    )
