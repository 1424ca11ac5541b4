"""Registered queries over the given tables, each with its SQL twin where one exists.

A twin states the expected result on its own terms: plain SQL over the same
tables, with self-joins and patterns where the Spark job uses windows and rules.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.functions import text as X
from paperledger.functions import values as V
from paperledger.operators import analytics as A
from paperledger.operators import duplicates as D
from paperledger.operators import evaluate as E
from paperledger.operators import ledger as L
from paperledger.operators import limits as LM
from paperledger.operators import lookup as LO
from paperledger.operators import measures as M
from paperledger.operators import pipeline as P
from paperledger.operators import reports as R
from paperledger.operators import totals as TO
from paperledger.operators.extract import extract_bills
from paperledger.operators.vendors import merge_known_vendors, newest_logged_vendors, resolve_vendors
from paperledger.plans import views as VW
from paperledger.plans.lineage import cut_lineage, shared_folder
from paperledger.schemas import EXTRACTION, empty_extraction
from paperledger.sources import readers, writers
from paperledger.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-06-30 12:00:00"
EVENTS_AS_OF = "2024-01-12 00:22:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _stamp(column: str, name: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or column)


LEDGER = "with " + VW.LEDGER_SQL
TEXT = "with " + VW.TEXT_SQL
DUP = "with " + VW.DUP_SQL
DRAFTS = "with " + VW.DRAFTS_SQL

# --- ledger analytics -------------------------------------------------------


@query(LEDGER + """
select coalesce(category, 'misc') as category, count(*) as bills, cast(sum(amount) as double) as amount
from logged where amount is not null group by 1""")
def spend_by_category(spark, d):
    return A.by_category(A.logged(VW.ledger(spark, d)))


@query(LEDGER + """
select count(*) as bills, cast(coalesce(sum(amount), 0) as double) as amount, cast(coalesce(sum(gst), 0) as double) as gst,
  count(*) filter (auto_logged) as auto_logged, count(*) filter (not auto_logged) as manual from logged""")
def dashboard_totals(spark, d):
    return A.totals(A.logged(VW.ledger(spark, d)))


@query(LEDGER + """
select user_id, count(*) as bills, cast(coalesce(sum(amount), 0) as double) as amount, cast(coalesce(sum(gst), 0) as double) as gst,
  count(*) filter (auto_logged) as auto_logged, count(*) filter (not auto_logged) as manual from logged group by user_id""")
def totals_by_user(spark, d):
    return A.totals(A.logged(VW.ledger(spark, d)), ("user_id",))


@query(LEDGER + """
select vendor, count(*) as bills, cast(sum(amount) as double) as amount from logged
where amount is not null and vendor is not null group by 1 order by 3 desc, 1 limit 8""")
def top_vendors(spark, d):
    return A.top_vendors(A.logged(VW.ledger(spark, d)))


@query(LEDGER + """
select * from (select business_id, vendor, count(*) as bills, cast(sum(amount) as double) as amount,
  row_number() over (partition by business_id order by cast(sum(amount) as double) desc, vendor) as rank
  from logged where amount is not null and vendor is not null group by 1, 2) where rank <= 8""")
def top_vendors_by_business(spark, d):
    return A.top_vendors_by(A.logged(VW.ledger(spark, d)), "business_id")


@query(LEDGER + f"""
select strftime(s.day, '%Y-%m-%d') as day, count(bill_id) as bills, cast(coalesce(sum(amount), 0) as double) as amount
from (select unnest(generate_series(date '{AS_OF[:10]}' - 6, date '{AS_OF[:10]}', interval 1 day)) as day) s
left join logged on cast(confirmed_at as date) = cast(s.day as date) group by 1""")
def last_seven_days(spark, d):
    return A.last_days(A.logged(VW.ledger(spark, d)), _ts(AS_OF))


@query("""
with rules as (select c_custkey, date '2024-01-01' + cast(c_custkey % 28 as int) as first_day, c_custkey % 3 as p from customer),
days as (select c_custkey, p, unnest(generate_series(cast(first_day as timestamp), timestamp '2024-06-15', interval 7 day)) as day from rules where p = 0
  union all select c_custkey, p, unnest(generate_series(cast(first_day as timestamp), timestamp '2024-06-15', interval 14 day)) from rules where p = 1
  union all select c_custkey, p, unnest(generate_series(cast(first_day as timestamp), timestamp '2024-06-15', interval 3 month)) from rules where p = 2)
select 'rule/' || c_custkey || '/' || case p when 2 then strftime(day, '%Y-%m') else strftime(day, '%Y-%m-%d') end as payment_id, c_custkey as user_id
from days where day > timestamp '2024-03-31'""")
def due_recurring(spark, d):
    # What was posted up to the end of March comes from the same rules.
    key = F.col("c_custkey")
    rules = VW.table(spark, d, "customer").select(
        key.alias("rule_id"), key.alias("user_id"), F.lit("Old Mill").alias("vendor"), F.col("c_acctbal").alias("amount"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 28).cast("int")).alias("first_day"),
        F.when(key % 3 == 0, "weekly").when(key % 3 == 1, "fortnightly").otherwise("quarterly").alias("period"),
    )
    posted = R.expand_recurring(rules, _ts("2024-03-31 00:00:00"))
    return R.due_payments(R.expand_recurring(rules, _ts("2024-06-15 00:00:00")), posted).select("payment_id", "user_id")


@query(LEDGER + """
select strftime(s.day, '%Y-%m-%d') as day, count(bill_id) as bills, cast(coalesce(sum(amount), 0) as double) as amount
from (select unnest(generate_series(date '1996-02-01', date '1996-02-29', interval 1 day)) as day) s
left join logged on cast(confirmed_at as date) = cast(s.day as date) group by 1""")
def days_of_month(spark, d):
    return A.month_days(A.logged(VW.ledger(spark, d)), "1996-02")


@query(LEDGER + "select distinct strftime(confirmed_at, '%Y-%m') as month from logged")
def month_options(spark, d):
    return A.month_options(A.logged(VW.ledger(spark, d)))


@query(LEDGER + "select distinct coalesce(category, 'misc') as category from logged")
def category_options(spark, d):
    return A.category_options(A.logged(VW.ledger(spark, d)))


@query(LEDGER + "select distinct vendor from logged where vendor is not null")
def vendor_options(spark, d):
    return A.vendor_options(A.logged(VW.ledger(spark, d)))


@query(LEDGER + """
select bill_id, user_id, vendor, cast(amount as double) as amount from logged
where strftime(confirmed_at, '%Y-%m') = '1997-03' and coalesce(category, 'misc') = 'misc'""")
def scope_month_category(spark, d):
    bills = A.scope(A.logged(VW.ledger(spark, d)), "1997-03", "misc", "no such vendor")
    return bills.select("bill_id", "user_id", "vendor", F.col("amount").cast("double").alias("amount"))


@query(LEDGER + """
select count(*) as bills, cast(sum(amount) as double) as amount from logged
where vendor = 'old rod' and coalesce(category, 'misc') = 'rent'""")
def scope_unknown_month(spark, d):
    bills = A.scope(A.logged(VW.ledger(spark, d)), "2031-01", "rent", "old rod")
    return bills.agg(F.count("*").alias("bills"), F.sum("amount").cast("double").alias("amount"))


@query(LEDGER + """
select bill_id, user_id, strftime(confirmed_at, '%Y-%m-%d %H:%M:%S') as confirmed_at from logged
order by logged.confirmed_at desc, bill_id desc limit 20""")
def recent_bills(spark, d):
    return A.recent(A.logged(VW.ledger(spark, d))).select("bill_id", "user_id", _stamp("confirmed_at"))


@query(LEDGER + """
select user_id, bill_id, rank from (select *, row_number() over (partition by user_id order by confirmed_at desc, bill_id desc) as rank
from logged) where rank <= 3""")
def logged_list(spark, d):
    return A.newest_per_user(VW.ledger(spark, d), 3).select("user_id", "bill_id", F.col("rank").cast("bigint").alias("rank"))


@query(LEDGER + """
select user_id, bill_id, strftime(confirmed_at, '%Y-%m-%d %H:%M:%S') as confirmed_at from (
select *, row_number() over (partition by user_id order by confirmed_at desc, bill_id desc) as rank
from logged where confirmed_at >= timestamp '2000-01-01') where rank = 1""")
def recent_logged(spark, d):
    return A.recent_logged(VW.ledger(spark, d), _ts("2000-01-01 00:00:00")).select("user_id", "bill_id", _stamp("confirmed_at"))


@query(LEDGER + """
select bill_id, vendor, status, cast(amount as double) as amount from ledger where user_id = 11""")
def bills_of_user(spark, d):
    return VW.ledger(spark, d).filter("user_id = 11").select("bill_id", "vendor", "status", F.col("amount").cast("double").alias("amount"))


def _report_rows(spark, d):
    return A.logged(VW.ledger(spark, d)).select(
        "bill_id",
        "confirmed_at",
        F.date_format("confirmed_at", "yyyy-MM-dd").alias("date"),
        F.when(F.col("bill_id") % 4 == 0, F.concat(F.lit('the "best", '), "vendor")).otherwise(F.col("vendor")).alias("vendor"),
        F.lit(None).cast("string").alias("vendor_resolved_to"),
        A.category_name().alias("category"),
        "amount",
        "gst",
        "gst_basis",
        F.lit(None).cast("string").alias("invoice_number"),
        F.lit(None).cast("string").alias("abn"),
        "auto_logged",
        F.when(F.col("auto_logged"), "high").alias("gate_level"),
    )


@query(LEDGER + """
select strftime(confirmed_at, '%Y-%m-%d') || ',' || strftime(confirmed_at, '%Y-%m-%d') || ','
  || case when vendor is null then '' when bill_id % 4 = 0 then '"the ""best"", ' || vendor || '"' else vendor end || ',,'
  || coalesce(category, 'misc') || ',' || coalesce(cast(amount as varchar), '') || ',' || coalesce(cast(gst as varchar), '') || ','
  || gst_basis || ',,,' || case when auto_logged then 'auto,high' else 'manual,' end as line from logged""")
def accountant_lines(spark, d):
    return writers.csv_lines(_report_rows(spark, d))


@query(LEDGER + """
select distinct 'bills-' || strftime(confirmed_at, '%Y-%m') || '-' || coalesce(category, 'misc')
  || case when vendor is null then '' else '-' || replace(vendor, ' ', '-') end || '.csv' as file_name from logged""")
def extract_names(spark, d):
    bills = A.logged(VW.ledger(spark, d))
    name = writers.extract_name(V.month_key(F.col("confirmed_at")), F.upper(A.category_name()), F.col("vendor"))
    return bills.select(name.alias("file_name")).distinct()


@query("""
select event_id, user_id || '/' || strftime(ts, '%Y/%m') || '/' || event_type || '_' || event_id || '_.'
  || case when event_id % 3 = 0 then 'png' when event_id % 3 = 1 then 'pdf' else 'jpg' end as path from events""")
def archive_paths(spark, d):
    key = F.col("event_id")
    media = F.concat("event_type", F.lit("+"), key.cast("string"), F.lit("/"))
    mime = F.when(key % 3 == 0, "image/png").when(key % 3 == 1, "application/pdf").otherwise("x/unknown")
    path = V.archive_path(F.col("user_id").cast("string"), F.col("ts"), media, mime)
    return VW.table(spark, d, "events").select("event_id", path.alias("path"))


@query("""
select event_id, coalesce(cast(case when event_id % 5 <> 0 then json_extract(props, '$.k') end as bigint), -1) as k from events""")
def decoded_props(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{bad "), "props")).otherwise(F.col("props"))
    k = F.coalesce(F.from_json(text, "k bigint")["k"], F.lit(-1).cast("bigint"))
    return VW.table(spark, d, "events").select("event_id", k.alias("k"))


@query("""
select doc_id as id, case when lang in ('en', 'de') then 'images' else 'synthetic' end || '/' || source || '.' || ext as path
from (select source as id, *, row_number() over (partition by source order by case when lang in ('en', 'de') then 1 else 2 end,
  case ext when 'jpg' then 1 when 'jpeg' then 2 else 3 end, doc_id) as rn from
  (select *, case doc_id % 3 when 0 then 'png' when 1 then 'jpeg' else 'jpg' end as ext from documents)) where rn = 1""".replace("doc_id as id", "source as id"))
def manifest_pick(spark, d):
    ext = F.when(F.col("doc_id") % 3 == 0, "png").when(F.col("doc_id") % 3 == 1, "jpeg").otherwise("jpg")
    folder = F.when(F.col("lang").isin("en", "de"), "images").otherwise("synthetic")
    files = VW.table(spark, d, "documents").select(
        F.col("source").alias("id"), folder.alias("dir"), ext.alias("ext"),
        F.concat(folder, F.lit("/"), "source", F.lit("."), ext).alias("path"),
    )
    return E.resolve_manifest(files, ["images", "synthetic"], ["jpg", "jpeg", "png", "webp", "heic", "pdf"])


# --- duplicates -------------------------------------------------------------

_MATCHES = DUP + """,
earlier as (select c.bill_id, p.bill_id as other, p.confirmed_at as seen_at,
    case when p.invoice_number = c.invoice_number then 'invoice' else 'vendor_amount' end as matched_on
  from dup_ledger c join dup_ledger p on p.user_id = c.user_id and p.status in ('logged', 'paid')
    and (p.confirmed_at, p.bill_id) < (c.confirmed_at, c.bill_id) and p.confirmed_at >= c.confirmed_at - interval 90 day
    and (p.invoice_number = c.invoice_number or (p.vendor = c.vendor and p.amount = c.amount))),
found as (select bill_id, arg_max(other, row(seen_at, other)) as duplicate_of, matched_on from earlier group by bill_id, matched_on),
best as (select bill_id, arg_min(duplicate_of, matched_on) as duplicate_of, min(matched_on) as matched_on from found group by bill_id)
"""


@query(_MATCHES + "select bill_id, best.duplicate_of, best.matched_on from dup_ledger left join best using (bill_id)")
def duplicate_gate(spark, d):
    # The gate reads its input four times; the view behind it joins three tables.
    bills = cut_lineage(VW.dup_ledger(spark, d))
    return D.find_duplicates(bills).select("bill_id", "duplicate_of", "matched_on")


@query(_MATCHES + """
select least(b.bill_id, duplicate_of) as a, greatest(b.bill_id, duplicate_of) as b, true as known,
  coalesce(x.invoice_number = y.invoice_number, false) or coalesce(x.vendor = y.vendor and x.amount = y.amount, false) as matches
from best b join dup_ledger x on x.bill_id = b.bill_id join dup_ledger y on y.bill_id = duplicate_of""")
def duplicate_pair_audit(spark, d):
    # The matches feed three inputs of the audit.
    return D.audit_pairs(cut_lineage(D.find_duplicates(cut_lineage(VW.dup_ledger(spark, d)))))


@query(_MATCHES + """
select bill_id, bill_id % 3 <> 1 and user_id % 10 <> 0 and auto_logged and best.duplicate_of is null as auto_log
from dup_ledger left join best using (bill_id)""")
def auto_log_decision(spark, d):
    bills = D.find_duplicates(cut_lineage(VW.dup_ledger(spark, d))).select(
        "bill_id",
        "duplicate_of",
        F.when(F.col("auto_logged"), "high").otherwise("partial").alias("gate"),
        (F.col("bill_id") % 3 == 1).alias("machine_read"),
        (F.col("user_id") % 10 != 0).alias("auto_save"),
    )
    return D.auto_log(bills).select("bill_id", "auto_log")


# --- extraction -------------------------------------------------------------

_RESOLVED = TEXT + """,
known as (select distinct upper(p_name) as name, translate(upper(p_name), 'L', 'I') as shape from part),
seen as (select *, upper(split_part(text, chr(10), 1)) as plain from bill_text where vendor is not null),
near as (select s.bill_id, k.name,
    levenshtein(split_part(translate(s.plain, 'L', 'I'), ' ', 1), split_part(k.shape, ' ', 1)) as d1,
    levenshtein(split_part(translate(s.plain, 'L', 'I'), ' ', 2), split_part(k.shape, ' ', 2)) as d2
  from seen s join known k on k.name <> s.plain),
ranked as (select bill_id, d1 + d2 as d, min(name) as name, count(*) as n,
    row_number() over (partition by bill_id order by d1 + d2) as rn
  from near where d1 <= 1 and d2 <= 1 group by 1, 2),
resolved as (select bill_id, name from ranked where rn = 1 and n = 1)
"""


@query(TEXT + """
select bill_id, amount, date, read_vendor as vendor, gst_basis, gst,
  case when read_vendor is null then 'partial' else 'high' end as gate from bill_text""")
def extracted_bills(spark, d):
    out = extract_bills(VW.bill_text(spark, d).select("bill_id", "text"), ocr_text=F.col("text"))
    e = F.col("extraction")
    value = lambda f: e[f]["value"].alias(f)
    return out.select("bill_id", value("amount"), value("date"), value("vendor"), e["gst_basis"].alias("gst_basis"), value("gst"), "gate")


@query(TEXT + """
select bill_id, cast(regexp_extract(text, 'Total: .([0-9.]+)', 1) as double) as amount,
  regexp_extract(text, '[0-9]{2}/[0-9]{2}/[0-9]{4}') as date from bill_text""")
def amount_and_date(spark, d):
    from paperledger.operators.extract import read_text

    out = read_text(VW.bill_text(spark, d).select("bill_id", "text"), F.col("text"))
    return out.select("bill_id", F.col("reading.amount.value").alias("amount"), F.col("reading.date.value").alias("date"))


@query(TEXT + "select bill_id, 'Total: $' || printf('%.2f', amount) as line from bill_text")
def amount_lines(spark, d):
    t = VW.bill_text(spark, d)
    return t.select("bill_id", V.amount_line(F.col("text"), F.col("amount")).alias("line"))


_WORDS = "list_filter(string_split_regex(text, '[\\s\\x0b]+'), lambda x: regexp_full_match(x, '[A-Za-z]+'))"


@query(f"""
with w as (select doc_id, {_WORDS} as words from documents)
select doc_id, len(words) >= 8 and len(list_filter(words, lambda x: len(x) <= 2)) * 2 >= len(words) as garbage from w""")
def garbage_texts(spark, d):
    return VW.table(spark, d, "documents").select("doc_id", X.is_garbage(F.col("text")).alias("garbage"))


# The wordings of the rules, as in functions.text.
@query("""
select doc_id, case when regexp_matches(text, '(?i)gst\\s*inclusive|\\binc\\s*gst|\\bgst\\s*inc\\b') then 'inclusive'
  when regexp_matches(text, '(?i)\\bgst\\b|\\btax\\b') then 'exclusive' else 'none' end as basis,
  case when regexp_matches(text, '(?i)\\bwages?\\b|\\bsalary\\b') then 'wages' when regexp_matches(text, '(?i)\\brent\\b') then 'rent'
  when regexp_matches(text, '(?i)\\belectricity|power|water|gas|phone|internet|energy|utilities?\\b') then 'utilities'
  when regexp_matches(text, '(?i)\\binventory|stock|supplies|supplier|materials\\b') then 'inventory'
  when regexp_matches(text, '(?i)\\bmisc\\b') then 'misc' end as category from documents""")
def basis_and_category(spark, d):
    t = F.col("text")
    return VW.table(spark, d, "documents").select("doc_id", X.gst_basis(t).alias("basis"), X.category_of(t).alias("category"))


# The two shapes of dates that the guard is defined by.
_FRAGMENT = (
    r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b|\b\d{1,2}-[A-Za-z]{3}-\d{2,4}\b"
    r"|\b\d{1,2}[/\-]\d{1,2}\s+\d{2,4}\b|\b\d{1,2}:\d{2}\b|\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}\b"
    r"|\b\d{1,2}\s*[/\-.]\s*\d{1,2}\s*[/\-.]\s*\d{2,4}\b"
)
_PLAIN = (
    r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{1,2}-[A-Za-z]{3}-\d{2,4}\b"
    r"|\b\d{1,2}-\d{1,2}-\d{2,4}\b|\b\d{1,2}\.\d{1,2}\.\d{2,4}\b"
)
_GUARD = f"""
with g as (select doc_id, len(regexp_extract_all(text, '{_FRAGMENT}')) as fragments,
  regexp_matches(text, '{_PLAIN}') as plain, nullif(regexp_extract(text, '\\b\\d+(?:\\.\\d{{1,2}})?\\b'), '') as naive from documents)
"""


@query(_GUARD + """select doc_id, fragments, fragments > 0 and not plain as guard_fired,
  floor((cast(naive as double) + 2.220446049250313e-16) * 100 + 0.5) / 100 as naive_leak from g""")
def date_guard(spark, d):
    g = E.date_guard(VW.table(spark, d, "documents").select("doc_id", "text"))
    naive = F.when(F.col("naive_leak").isNotNull(), F.col("naive_leak"))
    return g.select("doc_id", F.col("fragments").cast("bigint").alias("fragments"), "guard_fired", naive.alias("naive_leak"))


@query(_GUARD + """select count(*) as texts, count(*) filter (fragments > 0) as with_fragments,
  count(*) filter (fragments > 0 and not plain) as guard_firings,
  count(*) filter (fragments > 0 and not plain) / cast(count(*) as double) as guard_fire_rate from g""")
def date_guard_rate(spark, d):
    return E.guard_rate(E.date_guard(VW.table(spark, d, "documents").select("doc_id", "text")))


@query("""
with n as (select c_custkey, cast(c_custkey * 7919 + 10000000000 as varchar) as abn, c_acctbal from customer),
w as (select *, list_sum(list_transform(range(1, 12), lambda i: cast(substr(abn, cast(i as int), 1) as int) * [10,1,3,5,7,9,11,13,15,17,19][i])) - 10 as total from n)
select c_custkey, total % 89 = 0 as abn_ok, floor((abs(c_acctbal) / 11 + 2.220446049250313e-16) * 100 + 0.5) / 100 as gst,
  case when c_acctbal < 0 then '-$' else '$' end || format('{:,.2f}', abs(c_acctbal)) as money from w""")
def value_rules(spark, d):
    abn = (F.col("c_custkey") * 7919 + 10000000000).cast("string")
    return VW.table(spark, d, "customer").select(
        "c_custkey",
        V.abn_ok(abn).alias("abn_ok"),
        V.compute_gst(F.abs("c_acctbal"), F.lit("inclusive"), F.lit(True)).alias("gst"),
        V.format_aud(F.col("c_acctbal")).alias("money"),
    )


@query("""
with s as (select l_orderkey, l_linenumber, l_shipdate as t from lineitem)
select l_orderkey, l_linenumber, strftime(t, '%Y-%m-%d') as iso, strftime(t, '%Y-%m-%d') as slashed, strftime(t, '%Y-%m-%d') as named,
  case when try_strptime(strftime(t, '%Y-%m-') || '30', '%Y-%m-%d') is not null then strftime(t, '%Y-%m-') || '30' end as thirtieth from s""")
def normalised_dates(spark, d):
    lines = VW.table(spark, d, "lineitem")
    made = lambda pattern: V.normalise_date(F.date_format("l_shipdate", pattern))
    thirtieth = V.normalise_date(F.concat(F.lit("30."), F.date_format("l_shipdate", "M.yyyy")))
    return lines.select(
        "l_orderkey", "l_linenumber", made("yyyy-M-d").alias("iso"), made("d / M / yy").alias("slashed"),
        made("d MMMM yyyy").alias("named"), thirtieth.alias("thirtieth"),
    )


@query("""
select o_orderkey, o_totalprice as grouped, o_totalprice as marked, cast(null as double) as broken from orders""")
def parsed_amounts(spark, d):
    price = F.col("o_totalprice")
    return VW.table(spark, d, "orders").select(
        "o_orderkey",
        V.parse_amount(F.format_string("$ %,.2f", price)).alias("grouped"),
        V.parse_amount(F.format_string(" rs. %.2f ", price)).alias("marked"),
        V.parse_amount(F.format_string("%.3f", price)).alias("broken"),
    )


@query("""
select event_id, case when event_id % 4 = 3 then 'ocr' else 'ai' end as source, case when event_id % 4 in (0, 2) then value end as amount,
  case when event_id % 4 <> 3 then strftime(ts, '%Y-%m-%d') end as date, case when event_id % 4 <> 3 then event_type end as vendor,
  case when event_id % 4 in (0, 2) then 'high' else 'low' end as gate from events""")
def answered_bills(spark, d):
    """Text without a readable amount, read from a stored answer instead.

    The answer is fenced and has a trailing comma; on some rows the text does not
    show the amount, or the answer is not JSON.
    """
    key, value = F.col("event_id"), F.format_string("%.2f", "value")
    shown = F.when(key % 4 != 1, F.concat(F.lit("x"), V.number_text(F.col("value")), F.lit("x"))).otherwise(F.lit("x"))
    texts = VW.table(spark, d, "events").select(
        "event_id",
        F.concat(shown, F.lit(" y"), F.date_format("ts", "ddMMyyyy"), F.lit("y")).alias("text"),
        F.when(key % 4 == 3, F.lit("I cannot read this")).otherwise(
            F.concat(
                F.lit('Here it is:\n```json\n{"amount": '),
                # An amount that no text shows, on the rows whose text hides it.
                F.when(key % 4 == 1, F.lit("98765432109.5")).otherwise(value),
                F.lit(', "date": "'),
                F.date_format("ts", "dd/MM/yyyy"),
                F.lit('", "vendor": "'),
                "event_type",
                F.lit('", "gst\\_basis": "none", "confidence": "high",}\n```'),
            )
        ).alias("answer"),
    )
    out = extract_bills(texts, ocr_text=F.col("text"), text_answer=F.col("answer"))
    e = F.col("extraction")
    # Where the answer is unreadable the text rules stand; their vendor is of no interest here.
    read = F.when(F.col("source") == "ai", e["vendor"]["value"])
    return out.select("event_id", "source", e["amount"]["value"].alias("amount"), e["date"]["value"].alias("date"), read.alias("vendor"), "gate")


# --- vendors ----------------------------------------------------------------


@query(_RESOLVED + """
select bill_id, coalesce(r.name, split_part(text, chr(10), 1)) as vendor, r.name as resolved_to from seen left join resolved r using (bill_id)""")
def canonical_vendors(spark, d):
    shown = VW.bill_text(spark, d).filter("vendor is not null")
    shown = shown.select("bill_id", F.split("text", "\n")[0].alias("shown"))
    known = VW.table(spark, d, "part").select(F.upper("p_name").alias("vendor")).distinct()
    out = resolve_vendors(shown, "shown", known, into="resolved_to")
    return out.select("bill_id", F.coalesce("resolved_to", "shown").alias("vendor"), "resolved_to")


@query(_RESOLVED + """
select s.bill_id, s.amount, coalesce(r.name, split_part(text, chr(10), 1)) as vendor, r.name as vendor_resolved_to,
  case when r.name is null then 1.0::double else 0.9::double end as confidence
from seen s left join resolved r using (bill_id) union all select bill_id, amount, read_vendor, null, case when read_vendor is null then 0.0::double else 1.0::double end
from bill_text where vendor is null""")
def extracted_with_learned_vendors(spark, d):
    known = VW.table(spark, d, "part").select(F.upper("p_name").alias("vendor")).distinct()
    texts = VW.bill_text(spark, d).select("bill_id", "text")
    e = F.col("extraction")
    return extract_bills(texts, ocr_text=F.col("text"), vendors=known).select(
        "bill_id",
        e["amount"]["value"].alias("amount"),
        e["vendor"]["value"].alias("vendor"),
        e["vendor_resolved_to"]["value"].alias("vendor_resolved_to"),
        e["vendor"]["confidence"].alias("confidence"),
    )


@query(LEDGER + """
, newest as (select user_id, vendor from (select *, row_number() over (partition by user_id order by confirmed_at desc, bill_id desc) as rank
  from logged) where rank <= 5)
select distinct user_id, vendor from newest where vendor is not null
union all select null, unnest(['Telstra', 'Origin Energy', 'Bunnings',
  'Caltex', 'Homebase', 'Rajesh', 'Reliance Hypermart Limited', 'HDFC Bank', 'Gujarat Freight Tools'])""")
def known_vendors(spark, d):
    learned = newest_logged_vendors(VW.ledger(spark, d), n=5)
    return merge_known_vendors(learned, "user_id").select("user_id", "vendor")


@query(LEDGER + """
, asked as (select c_custkey as user_id, 'te1stra' as shown from customer union all
  select c_custkey, upper(p_name) || 'x' from customer, part where p_partkey = c_custkey % 7 + 1),
learned as (select distinct user_id, vendor from logged where vendor is not null),
pairs as (select a.user_id, shown, 'Telstra' as vendor, 1 as d from asked a where shown = 'te1stra'
  union select a.user_id, shown, l.vendor,
    levenshtein(split_part(translate(upper(shown), 'L', 'I'), ' ', 1), split_part(translate(upper(vendor), 'L', 'I'), ' ', 1))
    + levenshtein(split_part(translate(upper(shown), 'L', 'I'), ' ', 2), split_part(translate(upper(vendor), 'L', 'I'), ' ', 2))
  from asked a join learned l on l.user_id = a.user_id where shown <> 'te1stra'
    and levenshtein(split_part(translate(upper(shown), 'L', 'I'), ' ', 1), split_part(translate(upper(vendor), 'L', 'I'), ' ', 1)) <= 1
    and levenshtein(split_part(translate(upper(shown), 'L', 'I'), ' ', 2), split_part(translate(upper(vendor), 'L', 'I'), ' ', 2)) <= 1),
ranked as (select user_id, shown, d, min(vendor) as vendor, count(*) as n, row_number() over (partition by user_id, shown order by d) as rn from pairs group by 1, 2, 3)
select a.user_id, a.shown, case when n = 1 then vendor end as resolved_to
from (select distinct * from asked) a left join ranked r on r.user_id = a.user_id and r.shown = a.shown and rn = 1""")
def vendors_by_user(spark, d):
    # Every user knows the seed names; only some have learned the misread one.
    users = VW.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    parts = VW.table(spark, d, "part").select("p_partkey", F.concat(F.upper("p_name"), F.lit("x")).alias("shown"))
    misread = users.withColumn("p_partkey", F.col("user_id") % 7 + 1).join(parts, "p_partkey").select("user_id", "shown")
    asked = users.select("user_id", F.lit("te1stra").alias("shown")).unionByName(misread).distinct()
    known = merge_known_vendors(newest_logged_vendors(VW.ledger(spark, d)), "user_id")
    return resolve_vendors(asked, "shown", known, scope="user_id").select("user_id", "shown", "resolved_to")


# --- evaluation -------------------------------------------------------------


def _scored(spark, d):
    """Extraction of the composed bills, with every 41st label made wrong."""
    truth = VW.bill_text(spark, d)
    key = F.col("bill_id")
    labels = truth.select(
        key.alias("id"),
        "text",
        F.lit(True).alias("should_log"),
        (key % 7 == 0).alias("hard"),
        F.struct(
            F.when(key % 41 == 0, F.col("amount") + 1).otherwise(F.col("amount")).alias("amount"),
            F.when(key % 11 != 0, F.col("date")).alias("date"),
            F.when(key % 43 == 0, F.lit("someone else")).otherwise(F.lower("vendor")).alias("vendor"),
            F.col("gst").alias("gst"),
            F.col("gst_basis").alias("gst_basis"),
            F.lit(None).cast("string").alias("abn"),
            F.lit(None).cast("string").alias("invoice_number"),
        ).alias("expected"),
    )
    docs = readers.read_spread(spark, f"{d}/documents.parquet").select(
        (-F.col("doc_id") - 1).alias("id"),
        "text",
        F.lit(False).alias("should_log"),
        F.lit(False).alias("hard"),
        F.lit(None).cast(labels.schema["expected"].dataType).alias("expected"),
    )
    out = extract_bills(labels.unionByName(docs), ocr_text=F.col("text"))
    return E.score(out.drop("text"))


# Truth-based twin: what the composed text must yield, checked against the labels.
_SCORED = TEXT + """,
judged as (select bill_id as id, bill_id % 7 = 0 as hard, bill_id % 41 <> 0 as ok_amount,
    case when bill_id % 11 <> 0 then true end as ok_date,
    case when vendor is null and bill_id % 43 <> 0 then null when bill_id % 43 = 0 then false
      when bill_id % 3 = 0 then lower(split_part(text, chr(10), 1)) = lower(vendor) else true end as ok_vendor,
    case when gst is not null then true end as ok_gst, read_vendor is not null as has_vendor from bill_text)
"""


@query(_SCORED + """
select id, ok_amount, ok_date, ok_vendor, ok_gst, ok_amount as success,
  case when has_vendor then 'high' else 'partial' end as gate from judged""")
def scored_bills(spark, d):
    s = _scored(spark, d).filter("should_log")
    return s.select("id", "ok_amount", "ok_date", "ok_vendor", "ok_gst", "success", "gate")


_METRICS = _SCORED + """,
m as (select count(*) as bills, count(*) filter (ok_amount) / cast(count(*) as double) as success_rate,
  count(*) filter (hard) as hard_n, count(*) filter (hard and ok_amount) / cast(count(*) filter (hard) as double) as hard_rate,
  count(*) as amount_n, count(*) filter (ok_amount) as amount_correct,
  count(ok_date) as date_n, count(*) filter (ok_date) as date_correct,
  count(ok_vendor) filter (has_vendor) as vendor_n, count(*) filter (ok_vendor and has_vendor) as vendor_correct,
  count(ok_gst) as gst_n, count(*) filter (ok_gst) as gst_correct from judged)
"""


@query(_METRICS + "select * from m")
def evaluation_metrics(spark, d):
    names = "bills success_rate hard_n hard_rate amount_n amount_correct date_n date_correct vendor_n vendor_correct gst_n gst_correct"
    return E.aggregate(_scored(spark, d)).select(*names.split())


@query(_METRICS + """
select * from (
  select 'success' as criterion, success_rate as value, 0.7::double as target from m
  union all select 'amount', amount_correct / cast(amount_n as double), 0.95 from m
  union all select 'date', date_correct / cast(date_n as double), 0.9 from m
  union all select 'vendor', vendor_correct / cast(vendor_n as double), 0.8 from m
  union all select 'gst', gst_correct / cast(gst_n as double), 1.0 from m), lateral (select value >= target as pass)""")
def evaluation_criteria(spark, d):
    return E.criteria(E.aggregate(_scored(spark, d))).select("criterion", "value", "target", "pass")


_SWEEP = _METRICS + """,
combos as (select a as amount_high, b as date_high, c as vendor_high, success_rate, amount_correct / cast(amount_n as double) as amount_accuracy,
  date_correct / cast(date_n as double) as date_accuracy, vendor_correct / cast(vendor_n as double) as vendor_accuracy
  from m, unnest([0.8::double, 0.85, 0.9, 0.95]) as x(a), unnest([0.75::double, 0.8, 0.85, 0.9, 0.95]) as y(b), unnest([0.6::double, 0.7, 0.75, 0.8, 0.9]) as z(c))
"""


@query(_SWEEP + "select * from combos")
def threshold_sweep(spark, d):
    names = "amount_high date_high vendor_high success_rate amount_accuracy date_accuracy vendor_accuracy"
    return E.sweep(_scored(spark, d)).select(*names.split())


@query(_SWEEP + "select amount_high, date_high, vendor_high, success_rate from combos order by 1 desc, 2 desc, 3 desc limit 1")
def recommended_thresholds(spark, d):
    return E.recommend(E.sweep(_scored(spark, d))).select("amount_high", "date_high", "vendor_high", "success_rate")


_LEVELS = [0.4, 0.7, 0.82, 0.88, 0.93, 0.97]
_GRADED = f"""
with conf as (select event_id as id, {_LEVELS}[event_id % 6 + 1] as c1, {_LEVELS}[event_id // 6 % 6 + 1] as c2, {_LEVELS}[event_id // 36 % 6 + 1] as c3 from events),
judged as (select *, not (id % 5 = 0 and c1 < 0.9) as ok_amount, not (id % 9 = 0 and c2 < 0.87) as ok_date, not (id % 3 = 0 and c3 < 0.85) as ok_vendor from conf),
combos as (select a as amount_high, b as date_high, c as vendor_high,
    count(*) filter (c1 >= 0.7 and ok_amount and ok_date) / cast(count(*) as double) as success_rate,
    count(*) filter (c1 >= a and ok_amount) / cast(count(*) filter (c1 >= a) as double) as amount_accuracy,
    count(*) filter (c2 >= b and ok_date) / cast(count(*) filter (c2 >= b) as double) as date_accuracy,
    count(*) filter (c3 >= c and ok_vendor) / cast(count(*) filter (c3 >= c) as double) as vendor_accuracy
  from judged, unnest([0.8::double, 0.85, 0.9, 0.95]) as x(a), unnest([0.75::double, 0.8, 0.85, 0.9, 0.95]) as y(b), unnest([0.6::double, 0.7, 0.75, 0.8, 0.9]) as z(c)
  group by 1, 2, 3)
"""


def _graded(spark, d):
    """Scored rows of many confidences, wrong more often where they are low."""
    key = F.col("event_id")
    level = lambda k: F.element_at(F.array(*map(F.lit, _LEVELS)), (k % 6 + 1).cast("int"))
    confs = VW.table(spark, d, "events").select(key, level(key).alias("c1"), level(F.floor(key / 6)).alias("c2"), level(F.floor(key / 36)).alias("c3"))
    field = lambda c: F.struct(F.lit("x").alias("value"), F.col(c).alias("confidence"))
    return confs.select(
        key.alias("id"), F.lit(True).alias("should_log"), F.lit(False).alias("hard"),
        (~((key % 5 == 0) & (F.col("c1") < 0.9))).alias("ok_amount"), (~((key % 9 == 0) & (F.col("c2") < 0.87))).alias("ok_date"),
        (~((key % 3 == 0) & (F.col("c3") < 0.85))).alias("ok_vendor"), F.lit(None).cast("boolean").alias("ok_gst"),
        F.struct(field("c1").alias("amount"), field("c2").alias("date"), field("c3").alias("vendor")).alias("extraction"),
    )


@query(_GRADED + "select * from combos")
def sweep_of_confidences(spark, d):
    names = "amount_high date_high vendor_high success_rate amount_accuracy date_accuracy vendor_accuracy"
    return E.sweep(_graded(spark, d)).select(*names.split())


@query(_GRADED + """
select amount_high, date_high, vendor_high from combos
where success_rate >= 0.7 and amount_accuracy >= 0.95 and date_accuracy >= 0.9 and vendor_accuracy >= 0.8
order by round(amount_high + date_high + vendor_high, 6) desc, success_rate desc, 1, 2, 3 limit 1""")
def recommended_of_confidences(spark, d):
    return E.recommend(E.sweep(_graded(spark, d))).select("amount_high", "date_high", "vendor_high")


@query(_GRADED + """,
passing as (select * from combos where success_rate >= 0.7 and amount_accuracy >= 0.95 and date_accuracy >= 0.9 and vendor_accuracy >= 0.8),
best as (select * from passing order by round(amount_high + date_high + vendor_high, 6) desc, success_rate desc, 1, 2, 3 limit 1)
select (select count(*) from events) as scored, (select count(*) from combos) as points, (select count(*) from passing) as passing_count,
  exists(select 1 from passing where amount_high = 0.9 and date_high = 0.85 and vendor_high = 0.75) as defaults_pass,
  (select amount_high from best) as amount_high, (select date_high from best) as date_high, (select vendor_high from best) as vendor_high""")
def sweep_report(spark, d):
    scored = _graded(spark, d)
    report = writers.sweep_report(E.sweep(scored), scored.agg(F.count("*").alias("scored")))
    return report.select(
        "corpus.scored", F.size("combos").cast("long").alias("points"), "passing_count", F.col("defaults.pass").alias("defaults_pass"),
        "recommended.amount_high", "recommended.date_high", "recommended.vendor_high",
    )


@query(TEXT + """
select count(*) as texts, count(*) as with_fragments, 0::bigint as guard_firings, 0::double as guard_fire_rate,
  count(*) filter (read_vendor is not null) as high, count(*) filter (read_vendor is null) as partial, 0::bigint as low from bill_text""")
def read_report(spark, d):
    out = extract_bills(VW.bill_text(spark, d).select("bill_id", "text"), ocr_text=F.col("text"))
    return writers.read_summary(E.read_entries(out, id_col="bill_id")).select("texts", "date_guard.*", "gating.*")


@query(_SCORED + """
select count(*) filter (has_vendor) as high, count(*) filter (not has_vendor) as partial, 0::bigint as low from judged""")
def gate_histogram(spark, d):
    out = extract_bills(VW.bill_text(spark, d).select("bill_id", "text"), ocr_text=F.col("text"))
    counts = out.groupBy().pivot("gate", ["high", "partial", "low"]).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


@query()
def non_bill_safety(spark, d):
    return E.aggregate(_scored(spark, d)).select("non_bills", "non_bills_safe", "gate_high", "gate_partial", "gate_low")


@query(TEXT + """
select count(*) filter (gst_basis = 'inclusive') as inclusive, count(*) filter (gst_basis = 'exclusive') as exclusive,
  count(*) filter (gst_basis = 'none') as none, count(*) filter (bill_id % 2 = 0) as portrait,
  count(*) filter (bill_id % 2 <> 0) as landscape, count(*) filter (bill_id % 7 = 0) as hard from bill_text""")
def corpus_composition(spark, d):
    key = F.col("bill_id")
    labels = VW.bill_text(spark, d).select(
        F.struct("gst_basis").alias("expected"),
        F.when(key % 2 == 0, "portrait").otherwise("landscape").alias("orientation"),
        (key % 7 == 0).alias("hard"),
    )
    return E.composition(labels)


@query("select count(*) as labels, count(*) filter (quality = 1) as matched from labels join documents using (doc_id)")
def label_match(spark, d):
    labels = VW.table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    docs = VW.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    matched, _ = E.match_labels(labels, docs)
    return matched.agg(F.count("*").alias("labels"), F.count_if(F.col("quality") == 1).alias("matched"))


@query("select doc_id as id from documents where doc_id not in (select doc_id from labels)")
def unmatched_documents(spark, d):
    labels = VW.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    docs = VW.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return E.match_labels(docs, labels)[1]


@query("""
with x as (select event_id as id, case when value >= 50 then 'high' when value >= 10 then 'partial' else 'low' end as before,
  case when event_id % 9 = 0 then case when value >= 50 then 'low' else 'high' end when value >= 50 then 'high' when value >= 10 then 'partial' else 'low' end as after from events)
select count(*) as compared, count(*) filter (before <> after) as changed,
  count(*) filter ((before = 'high' and after = 'low') or (before = 'low' and after = 'high')) as flips,
  0::bigint as only_after, 0::bigint as only_before from x""")
def gate_drift(spark, d):
    v, key = F.col("value"), F.col("event_id")
    base = F.when(v >= 50, "high").when(v >= 10, "partial").otherwise("low")
    moved = F.when(key % 9 == 0, F.when(v >= 50, "low").otherwise("high")).otherwise(base)
    e = VW.table(spark, d, "events")
    return E.gate_drift(e.select(key.alias("id"), base.alias("gate")), e.select(key.alias("id"), moved.alias("gate")))


# --- drafts and ledger life cycle -------------------------------------------


@query(DRAFTS + f"""
select user_phone, id, flow_state from (select *, row_number() over (partition by user_phone order by created_at desc, id desc) as rn
from drafts where status = 'draft' and flow_expires_at > timestamp '{EVENTS_AS_OF}') where rn = 1""")
def active_drafts(spark, d):
    return L.active_drafts(VW.drafts(spark, d), _ts(EVENTS_AS_OF)).select("user_phone", "id", "flow_state")


@query(DRAFTS + f"""
select id, case when status = 'draft' and flow_expires_at <= timestamp '{EVENTS_AS_OF}' then 'expired' else status end as status,
  case when not (status = 'draft' and flow_expires_at <= timestamp '{EVENTS_AS_OF}') then flow_state end as flow_state from drafts""")
def expired_drafts(spark, d):
    return L.expire_due(VW.drafts(spark, d), _ts(EVENTS_AS_OF)).select("id", "status", "flow_state")


_NUDGE = f"""status = 'draft' and flow_nudged_at is null and flow_expires_at > timestamp '{EVENTS_AS_OF}'
  and flow_expires_at <= timestamp '{EVENTS_AS_OF}' + interval 4 minute and flow_state in ('awaiting_confirm', 'editing_amount', 'editing_vendor', 'editing_date')"""


@query(DRAFTS + f"select id, user_phone from drafts where {_NUDGE}")
def nudge_due(spark, d):
    return L.nudge_due(VW.drafts(spark, d), _ts(EVENTS_AS_OF)).select("id", "user_phone")


@query(DRAFTS + f"""select count(*) filter (status = 'draft' and flow_expires_at <= timestamp '{EVENTS_AS_OF}') as expired,
  count(*) filter ({_NUDGE}) as nudged from drafts""")
def sweep_counts(spark, d):
    return L.sweep(VW.drafts(spark, d), _ts(EVENTS_AS_OF))


@query(DRAFTS + """
select id, flow_state = 'queued' as bad from drafts""")
def domain_check(spark, d):
    domains = {"status": ["draft", "expired"], "flow_state": ["awaiting_confirm", "editing_amount", "editing_date", "processing"]}
    checked = L.check_domains(VW.drafts(spark, d), domains)
    return checked.select("id", (F.size("violations") > 0).alias("bad"))


@query(DRAFTS + """
select user_phone, wa_message_id, min(id) as id from drafts x where id % 3 = 0 and not exists (
  select 1 from drafts y where y.status = 'draft' and y.id % 3 <> 0 and y.user_phone = x.user_phone and y.wa_message_id = x.wa_message_id)
group by 1, 2""")
def insert_if_absent(spark, d):
    base = VW.drafts(spark, d)
    held, incoming = base.filter("id % 3 <> 0"), base.filter("id % 3 = 0")
    new = L.insert_if_absent(held, incoming.select("user_phone", "wa_message_id", "id"), ["user_phone", "wa_message_id"], ["id"])
    return new.select("user_phone", "wa_message_id", "id")


@query("""
with p as (select user_id as id, arg_max(value, (ts, event_id)) filter (event_type = 'purchase') as amount,
  arg_max(event_type, (ts, event_id)) filter (event_type in ('view', 'click')) as name from events group by 1)
select c_custkey as id, coalesce(p.name, c_name) as name, coalesce(p.amount, c_acctbal) as amount from customer left join p on p.id = c_custkey""")
def patched_settings(spark, d):
    kind = F.col("event_type")
    changes = VW.table(spark, d, "events").select(
        F.col("user_id").alias("id"), "ts", F.col("event_id").alias("change_id"),
        F.when(kind == "purchase", F.col("value")).alias("amount"),
        F.when(kind.isin("view", "click"), kind).alias("name"),
    )
    patch = L.latest_settings(changes, "id", "ts", ["amount", "name"])
    base = VW.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    return L.apply_patch(base, patch, "id")


@query("""
select event_id, coalesce(n_nationkey, -1) as business_id, coalesce(n_nationkey % 3 <> 0, true) as gst_registered,
  coalesce(n_nationkey % 4 <> 0, true) as auto_save from events
left join customer on c_custkey = user_id and c_custkey % 5 <> 0 left join nation on n_nationkey = c_nationkey""")
def enriched_events(spark, d):
    users = VW.table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(
        F.col("c_custkey").alias("user_phone"), F.col("c_nationkey").alias("business_id")
    )
    key = F.col("n_nationkey")
    businesses = VW.table(spark, d, "nation").select(
        key.alias("business_id"), (key % 3 != 0).alias("gst_registered"), (key % 4 != 0).alias("auto_save"),
        F.lit("Australia/Perth").alias("timezone"),
    )
    events = VW.table(spark, d, "events").select("event_id", F.col("user_id").alias("user_phone"))
    out = L.enrich_with_business(events, users, businesses)
    return out.select("event_id", F.coalesce("business_id", F.lit(-1)).alias("business_id"), "gst_registered", "auto_save")


@query("""
with r as (select user_id, max(ts) as asked_at from events where event_type = 'error' group by 1),
b as (select event_id as bill_id, user_id, ts, event_id % 2 = 0 as auto from events where event_type = 'purchase'),
t as (select r.user_id, arg_max((bill_id, ts, auto), (ts, bill_id)) as n, any_value(asked_at) as asked from r join b on b.user_id = r.user_id
  and ts <= asked_at and ts >= asked_at - interval 24 hour group by 1)
select r.user_id, t.n[1] as bill_id, case when t.n is null then 'nothing'
  when t.n[2] < r.asked_at - case when t.n[3] then interval 24 hour else interval 5 minute end then 'too_late' else 'deleted' end as outcome
from r left join t using (user_id)""")
def undo_requests(spark, d):
    e = VW.table(spark, d, "events")
    asked = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("asked_at"))
    bills = e.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("bill_id"), "user_id", F.col("ts").alias("confirmed_at"),
        (F.col("event_id") % 2 == 0).alias("auto_logged"), F.lit("logged").alias("status"),
    )
    return L.undo(bills, asked).select("user_id", "bill_id", "outcome")


@query("""
with b as (select event_id as bill_id, user_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as rn
  from events where event_type = 'purchase')
select user_id, bill_id from b where rn <= 20 and ts >= timestamp '2024-01-30 21:00:00' - interval 2 hour""")
def deletable_bills(spark, d):
    e = VW.table(spark, d, "events").filter("event_type = 'purchase'")
    bills = e.select(F.col("event_id").alias("bill_id"), "user_id", F.col("ts").alias("confirmed_at"), F.lit("logged").alias("status"))
    asked = bills.select("user_id", "bill_id", _ts("2024-01-30 21:00:00").alias("asked_at"))
    return L.delete_requested(bills, asked).select("user_id", "bill_id")


@query("""
with f as (select cast(user_id as varchar) as user_phone, min(ts) as first from events where user_id not in (select c_custkey from customer where c_custkey % 3 = 0) group by 1)
select user_phone, substr(sha256('business:' || user_phone), 1, 32) as business_id, 'Australia/Sydney' as timezone, 'owner' as role,
  strftime(first, '%Y-%m-%d %H:%M:%S') as created_at from f""")
def onboarded_users(spark, d):
    seen = VW.table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_phone"), F.col("ts").alias("wa_received_at"))
    users = VW.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("user_phone"))
    return L.onboard(seen, users).select("user_phone", "business_id", "timezone", "role", _stamp("created_at"))


@query("""
with u as (select c_custkey as id, case c_custkey % 4 when 0 then 'name' when 1 then 'gst' end as step from customer where c_custkey % 5 <> 0),
live as (select distinct user_id from events where event_type = 'signup' and event_id % 3 = 0)
select event_id, case when u.id is null and event_type <> 'purchase' then 'onboard' when u.id is null then 'onboard_photo'
  when event_type = 'purchase' then 'photo' when u.step is not null then 'setup' when live.user_id is not null then 'reply' else 'command' end as route
from events left join u on u.id = user_id left join live using (user_id)""")
def routed_messages(spark, d):
    e = VW.table(spark, d, "events")
    messages = e.select("event_id", F.col("user_id").alias("user_phone"), F.when(F.col("event_type") == "purchase", "photo").otherwise("text").alias("kind"))
    key = F.col("c_custkey")
    users = VW.table(spark, d, "customer").filter(key % 5 != 0).select(
        key.alias("user_phone"), F.when(key % 4 == 0, "name").when(key % 4 == 1, "gst").alias("setup_step")
    )
    live = e.filter("event_type = 'signup' and event_id % 3 = 0").select(F.col("user_id").alias("user_phone"))
    return L.route(messages, users, live).select("event_id", "route")


@query("""
select event_id, cast(user_id as varchar) as user_phone, case event_type when 'purchase' then 'photo' else 'text' end as kind,
  case event_type when 'click' then '1' when 'view' then 'pay ' || value end as text,
  case event_type when 'purchase' then 'p' || event_id end as image, strftime(ts, '%Y-%m-%d %H:%M:%S') as received_at
from events where event_type in ('purchase', 'click', 'view')""")
def parsed_messages(spark, d):
    out = readers.inbound_messages(VW.messages(spark, d), "raw")
    return out.select("event_id", "user_phone", "kind", "text", F.get("image_urls", F.lit(0)).alias("image"), _stamp("wa_received_at", "received_at"))


@query(DRAFTS + """
select id, coalesce(user_phone = '7' and wa_message_id like 'm1%', false) as seeded from drafts
where not (user_phone = '7' and wa_message_id like 'm1%')
union all select id + 1000000, true from drafts where user_phone = '7' and wa_message_id like 'm1%'""")
def reloaded_seed(spark, d):
    table = VW.drafts(spark, d)
    seed = table.filter((F.col("user_phone") == "7") & F.col("wa_message_id").startswith("m1")).withColumn("id", F.col("id") + 1000000)
    once = L.reload_seed(table, seed, "7", "m1")
    twice = L.reload_seed(once, seed, "7", "m1")
    # After a reload the rows under the prefix are the seed's, whatever their ids.
    seeded = (F.col("user_phone") == "7") & F.col("wa_message_id").startswith("m1")
    return twice.select("id", F.coalesce(seeded, F.lit(False)).alias("seeded"))


@query("""
select event_id, case event_id % 3 when 0 then value end as amount_value, case event_id % 3 when 1 then event_type end as vendor_value,
  case event_id % 3 when 2 then strftime(ts, '%Y-%m-%d') end as date_value from events""")
def checked_edits(spark, d):
    key = F.col("event_id")
    edits = VW.table(spark, d, "events").select(
        "event_id",
        F.when(key % 3 == 0, "amount").when(key % 3 == 1, "vendor").otherwise("date").alias("field"),
        F.when(key % 3 == 0, F.format_string(" $%.2f", "value")).when(key % 3 == 1, F.concat(F.lit("  "), "event_type"))
        .otherwise(F.date_format("ts", "dd-MMM-yy")).alias("text"),
    )
    return L.check_edits(edits).select("event_id", "amount_value", "vendor_value", "date_value")


_EDITS = """
with edits as (select user_id * 3 + event_id % 3 as id, event_id as nth, event_id % 7 as kind, round(value, 2) as amount,
    event_type as vendor, strftime(ts, '%Y-%m-%d') as day from events),
last as (select id, arg_max(amount, nth) filter (kind < 2) as amount, arg_max(vendor, nth) filter (kind in (2, 3)) as vendor,
    arg_max(day, nth) filter (kind in (4, 5)) as day from edits where kind < 6 group by id),
drafts as (select c_custkey as id, c_custkey % 4 <> 0 as registered, ['inclusive', 'exclusive', 'none'][c_custkey % 3 + 1] as basis,
    case when c_custkey % 5 <> 0 then 80.5 end as amount, case when c_custkey % 5 = 0 then 0.0 when c_custkey % 2 = 0 then 0.95 else 0.75 end as sure,
    case when c_custkey % 7 <> 0 then '2024-01-02' end as day, case when c_custkey % 11 <> 0 then 'Shop Fern' end as vendor from customer),
merged as (select id, l.id is not null as corrected, coalesce(l.amount, d.amount) as amount, coalesce(l.vendor, d.vendor) as vendor, coalesce(l.day, d.day) as date,
    case when l.amount is null then 1.5 when registered and basis = 'inclusive' then floor((l.amount / 11 + 2.220446049250313e-16) * 100 + 0.5) / 100
      when registered and basis = 'exclusive' then floor((l.amount * 0.1::double + 2.220446049250313e-16) * 100 + 0.5) / 100 end as gst,
    case when l.vendor is null then 'fern' end as resolved, case when l.amount is null then sure else 1 end as sure
  from drafts d left join last l using (id))
"""


@query(_EDITS + """
select id, amount, vendor, date, gst, resolved, case when not corrected then 'old' when amount is not null and sure >= 0.9 and date is not null and vendor is not null then 'high'
  when amount is not null and sure >= 0.7 then 'partial' else 'low' end as gate from merged""")
def corrected_drafts(spark, d):
    key, at = F.col("c_custkey"), F.col("event_id")
    read = lambda v, c=0.9: F.struct(v.alias("value"), F.lit(c).cast("double").alias("confidence") if not hasattr(c, "alias") else c.alias("confidence"))
    sure = F.when(key % 5 == 0, 0.0).when(key % 2 == 0, 0.95).otherwise(0.75)
    values = {
        "amount": read(F.when(key % 5 != 0, 80.5), sure),
        "date": read(F.when(key % 7 != 0, F.lit("2024-01-02"))),
        "vendor": read(F.when(key % 11 != 0, F.lit("Shop Fern"))),
        "vendor_resolved_to": read(F.lit("fern")),
        "gst": read(F.lit(1.5)),
        "gst_basis": F.element_at(F.array(*map(F.lit, ["inclusive", "exclusive", "none"])), (key % 3 + 1).cast("int")),
    }
    x = F.struct(*[values.get(c, empty_extraction()[c]).alias(c) for c in EXTRACTION.names])
    drafts = VW.table(spark, d, "customer").select(key.alias("id"), x.alias("extraction"), (key % 4 != 0).alias("gst_registered"), F.lit("old").alias("gate"))
    kind = at % 7
    typed = F.when(kind < 2, F.format_string(" $%.2f", "value")).when(kind < 4, F.concat(F.lit(" "), "event_type")).when(kind < 6, F.date_format("ts", "dd/MM/yyyy")).otherwise("none of it")
    field = F.when((kind < 2) | (kind == 6), "amount").when(kind < 4, "vendor").otherwise("date")
    edits = VW.table(spark, d, "events").select((F.col("user_id") * 3 + at % 3).alias("id"), at.alias("edited_at"), field.alias("field"), typed.alias("text"))
    e = F.col("extraction")
    shown = {"amount": "amount", "vendor": "vendor", "date": "date", "gst": "gst", "resolved": "vendor_resolved_to"}
    return L.apply_edits(drafts, edits).select("id", *[e[c]["value"].alias(n) for n, c in shown.items()], "gate")


@query(TEXT + """
select bill_id, 'machine' as header, false as verify_amount, read_vendor is null as vendor_missing, false as offer_date_edit, true as abn_unverified from bill_text""")
def confirm_flags(spark, d):
    out = extract_bills(VW.bill_text(spark, d).select("bill_id", "text"), ocr_text=F.col("text"))
    return L.confirm_flags(out).select("bill_id", "header", "verify_amount", "vendor_missing", "offer_date_edit", "abn_unverified")


@query(TEXT + """
select bill_id, 'logged' as status, amount, gst, 'misc' as category, read_vendor as vendor from bill_text""")
def confirmed_drafts(spark, d):
    out = extract_bills(VW.bill_text(spark, d).select("bill_id", "text"), ocr_text=F.col("text"))
    rows = out.withColumnRenamed("extraction", "raw_extraction")
    done = L.confirm(rows, _ts(AS_OF), F.lit(False))
    money = lambda c: F.col(c).cast("double").alias(c)
    return done.select("bill_id", "status", money("amount"), money("gst"), "category", "vendor")


# --- life cycle as a stream -------------------------------------------------


def _inbound(spark, d):
    m = VW.inbound(spark, d)
    return m.select(
        "*",
        F.lit(1).alias("images"),
        F.when(F.col("kind") == "photo", 0.95).alias("amount_conf"),
        F.when(F.col("date").isNotNull(), 0.95).alias("date_conf"),
        F.when(F.col("kind") == "photo", "inclusive").alias("gst_basis"),
        (F.col("date").isNotNull() & ~F.col("machine_read")).alias("auto_ok"),
    )


@query()
def draft_replay(spark, d):
    return jobs.replay(_inbound(spark, d))


_PHOTOS = """
with photos as (select cast(user_id as varchar) as user_phone, user_id, event_id, ts, event_id % 3 as v, event_id % 4 as a from events where event_type = 'purchase'),
logged as (select * from photos qualify row_number() over (partition by user_phone, v, a order by ts, event_id) = 1),
deletes as (select user_phone, max(ts) + interval 20 minute as asked from photos where user_id % 2 = 1 group by 1),
gone as (select user_phone, arg_max(event_id, (ts, event_id)) as event_id from logged join deletes using (user_phone)
  where epoch_ms(ts) >= epoch_ms(asked) - 86400000 group by 1)
"""


def _photo_messages(spark, d):
    """Photos with a stored answer from few vendors and amounts, so that many are copies; odd users undo once at the end."""
    e = VW.table(spark, d, "events").filter("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp"))
    key = F.col("event_id")
    answer = F.concat(
        F.lit('{"amount": '), ((key % 4 + 1) * 11).cast("string"), F.lit(', "date": "'), F.date_format("ts", "dd/MM/yyyy"),
        F.lit('", "vendor": "Shop '), F.element_at(F.array(*map(F.lit, ("Alder", "Birch", "Cedar"))), (key % 3 + 1).cast("int")),
        F.lit('", "gst_basis": "inclusive", "confidence": "high"}'),
    )
    none = F.lit(None).cast("string")
    photos = e.select(
        F.col("user_id").cast("string").alias("user_phone"), F.lpad(key.cast("string"), 12, "0").alias("wa_message_id"),
        F.col("ts").alias("wa_received_at"), F.lit("photo").alias("kind"), F.array(F.lit("p")).alias("image_urls"),
        none.alias("text"), none.alias("ocr_text"), answer.alias("answer"),
    )
    last = e.filter("user_id % 2 = 1").groupBy("user_id").agg(F.max("ts").alias("ts"))
    deletes = last.select(
        F.col("user_id").cast("string").alias("user_phone"), F.lit("delete").alias("wa_message_id"),
        (F.col("ts") + F.expr("interval 20 minutes")).alias("wa_received_at"), F.lit("text").alias("kind"),
        F.array().cast("array<string>").alias("image_urls"), F.lit("delete").alias("text"), none.alias("ocr_text"), none.alias("answer"),
    )
    return photos.unionByName(deletes)


def _tenants(spark, d):
    users = VW.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_phone"), F.col("c_nationkey").alias("business_id"))
    key = F.col("n_nationkey")
    businesses = VW.table(spark, d, "nation").select(
        key.alias("business_id"), (key % 3 != 0).alias("gst_registered"), F.lit(True).alias("auto_save"), F.lit("Australia/Perth").alias("timezone")
    )
    return users, businesses


@query(_PHOTOS + """
select l.user_phone, lpad(cast(l.event_id as varchar), 12, '0') || '/0' as draft_id, case when g.event_id is not null then 'deleted' else 'logged' end as status,
  (a + 1) * 11::double as amount, case when coalesce(c_nationkey % 3 <> 0, true) then (a + 1)::double end as gst,
  'Shop ' || ['Alder', 'Birch', 'Cedar'][v + 1] as vendor, strftime(ts, '%Y-%m-%d') as date
from logged l left join gone g on g.user_phone = l.user_phone and g.event_id = l.event_id left join customer on c_custkey = l.user_id""")
def ledger_from_messages(spark, d):
    out = P.ledger_from_messages(_photo_messages(spark, d), *_tenants(spark, d), image_answer=F.col("answer"))
    money = lambda c: F.col(c).cast("double").alias(c)
    return out.select("user_phone", "draft_id", "status", money("amount"), money("gst"), "vendor", "date")


_SETTINGS_SQL = """
with photos as (select event_id, ts, user_id % 25 as business_id, event_id % 50 + 1 as tax from events where event_type = 'purchase'),
span as (select min(ts) as low from events),
changes as (
  select n_nationkey as business_id, low + to_hours(cast(24 * k + n_nationkey as int)) as ts, k as change_id,
    case k when 6 then false when 15 then true when 24 then false end as auto_save,
    case when n_nationkey % 2 = 0 then case k when 10 then true when 20 then false end when k = 15 then true when k = 24 then false end as gst_registered
  from nation, span, (select unnest([6, 10, 15, 20, 24]) as k)),
ruled as (select p.*,
  coalesce((select arg_max(c.auto_save, c.ts) from changes c where c.business_id = p.business_id and c.ts <= p.ts and c.auto_save is not null), true) as auto_save,
  coalesce((select arg_max(c.gst_registered, c.ts) from changes c where c.business_id = p.business_id and c.ts <= p.ts and c.gst_registered is not null), p.business_id % 3 <> 0) as registered
  from photos p)
"""


def _setting_changes(spark, d):
    """Five changes for each business, a few days apart; each leaves a setting alone."""
    low = VW.table(spark, d, "events").agg(F.min(F.col("ts").cast("timestamp")).alias("low"))
    days = VW.table(spark, d, "nation").select(F.col("n_nationkey").alias("business_id"), F.explode(F.array(*map(F.lit, (6, 10, 15, 20, 24)))).alias("k"))
    k, odd = F.col("k"), F.col("business_id") % 2 == 1
    return days.crossJoin(F.broadcast(low)).select(
        "business_id",
        (F.col("low") + F.make_dt_interval(k, F.col("business_id"))).alias("ts"),
        k.alias("change_id"),
        F.when(k == 6, False).when(k == 15, True).when(k == 24, False).alias("auto_save"),
        F.when(odd & (k == 15) | ~odd & (k == 10), True).when(odd & (k == 24) | ~odd & (k == 20), False).alias("gst_registered"),
    )


def _answer(amount, stamp, vendor):
    return F.concat(
        F.lit('{"amount": '), amount.cast("string"), F.lit(', "date": "'), F.date_format(stamp, "dd/MM/yyyy"),
        F.lit('", "vendor": "'), vendor, F.lit('", "gst_basis": "inclusive", "confidence": "high"}'),
    )


def _bills_with_replies(spark, d):
    """A photo of one bill from each purchase, by a sender of its own, who answers 1 two minutes later; senders and businesses."""
    e = VW.table(spark, d, "events").filter("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp"))
    key, none = F.col("event_id"), F.lit(None).cast("string")
    phone = key.cast("string").alias("user_phone")
    photos = e.select(
        phone, F.concat(F.lit("p"), key.cast("string")).alias("wa_message_id"), F.col("ts").alias("wa_received_at"), F.lit("photo").alias("kind"),
        F.array(F.lit("p")).alias("image_urls"), none.alias("text"), none.alias("ocr_text"), _answer((key % 50 + 1) * 11, "ts", F.lit("Shop Alder")).alias("answer"),
    )
    replies = e.select(
        phone, F.concat(F.lit("r"), key.cast("string")).alias("wa_message_id"), (F.col("ts") + F.expr("interval 2 minutes")).alias("wa_received_at"), F.lit("text").alias("kind"),
        F.array().cast("array<string>").alias("image_urls"), F.lit("1").alias("text"), none.alias("ocr_text"), none.alias("answer"),
    )
    users = e.select(phone, (F.col("user_id") % 25).alias("business_id"))
    businesses = VW.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("business_id"), (F.col("n_nationkey") % 3 != 0).alias("gst_registered"), F.lit(True).alias("auto_save"), F.lit("Australia/Perth").alias("timezone")
    )
    return photos.unionByName(replies), users, businesses


@query(_SETTINGS_SQL + """
select cast(event_id as varchar) as user_phone, auto_save as auto_logged, strftime(case when auto_save then ts else ts + interval 2 minute end, '%Y-%m-%d %H:%M:%S') as confirmed_at,
  tax * 11::double as amount, case when registered then tax::double end as gst from ruled""")
def ledger_with_settings(spark, d):
    messages, users, businesses = _bills_with_replies(spark, d)
    out = P.ledger_from_messages(messages, users, businesses, changes=_setting_changes(spark, d), image_answer=F.col("answer"))
    money = lambda c: F.col(c).cast("double").alias(c)
    return out.select("user_phone", "auto_logged", _stamp("confirmed_at"), money("amount"), money("gst"))


@query("""
with photos as (select event_id, ts, event_id % 4 + 1 as n, event_id % 2 = 0 as auto from events where event_type = 'purchase'),
images as (select *, unnest(range(n)) as i from photos)
select event_id || '/' || i as draft_id, i = 0 and auto as auto_logged, cast(11 * (event_id % 30 + 1) + i as double) as amount, 'Shop ' || chr(cast(65 + i as int)) as vendor,
  strftime(case when i = 0 and auto then ts when i = 0 then ts + interval 1 minute else ts + to_minutes(cast(2 * i + 1 as int)) end, '%Y-%m-%d %H:%M:%S') as confirmed_at
from images""")
def queued_image_bills(spark, d):
    """Photos of up to four bills each, answered one by one with ``next`` and ``1``: every image is logged with its own reading."""
    e = VW.table(spark, d, "events").filter("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp"))
    key, none = F.col("event_id"), F.lit(None).cast("string")
    phone = F.concat(F.lit("u"), key.cast("string")).alias("user_phone")
    numbers = F.sequence(F.lit(0).cast("bigint"), key % 4)
    # Only the even ones show a date, so only they are logged by themselves.
    answer = lambda i: F.concat(
        F.lit('{"amount": '), ((key % 30 + 1) * 11 + i).cast("string"), F.when(key % 2 == 0, F.concat(F.lit(', "date": "'), F.date_format("ts", "dd/MM/yyyy"), F.lit('"'))).otherwise(""),
        F.lit(', "vendor": "Shop '), F.substring(F.lit("ABCD"), (i + 1).cast("int"), F.lit(1)), F.lit('", "gst_basis": "none", "confidence": "high"}'),
    )
    photos = e.select(
        phone, key.cast("string").alias("wa_message_id"), F.col("ts").alias("wa_received_at"), F.lit("photo").alias("kind"), none.alias("text"), none.alias("ocr_text"),
        F.transform(numbers, lambda i: F.concat(F.lit("img"), i.cast("string"))).alias("image_urls"), F.transform(numbers, answer).alias("answers"),
    )
    said = F.explode(F.flatten(F.transform(numbers, lambda i: F.array(
        F.struct((i * 2).alias("minute"), F.when(i == 0, "help").otherwise("next").alias("text")),
        F.struct((i * 2 + 1).alias("minute"), F.lit("1").alias("text")),
    )))).alias("said")
    replies = e.select(phone, key, "ts", said).select(
        "user_phone", F.concat(F.lit("r"), key.cast("string"), F.lit("-"), F.col("said")["minute"].cast("string")).alias("wa_message_id"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("said")["minute"].cast("int"))).alias("wa_received_at"), F.lit("text").alias("kind"), F.col("said")["text"].alias("text"),
        none.alias("ocr_text"), F.array().cast("array<string>").alias("image_urls"), F.array().cast("array<string>").alias("answers"),
    )
    messages = P.deal_images(photos.unionByName(replies.filter("text <> 'help'")), {"answers": "answer"})
    users, businesses = _tenants(spark, d)
    out = P.ledger_from_messages(messages, users, businesses, image_answer=F.col("answer"))
    return out.select("draft_id", "auto_logged", F.col("amount").cast("double").alias("amount"), "vendor", _stamp("confirmed_at"))


@query("select cast(user_id as varchar) as user_phone, count(*) as contacts from (select distinct user_id from events where user_id % 3 <> 0) group by 1")
def new_contacts(spark, d):
    """First contacts where every third user is known from before."""
    known = VW.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("user_phone"))
    extra = VW.table(spark, d, "events").filter("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("user_phone"))
    onboarded = jobs.replay(_inbound(spark, d), users=known.unionByName(extra)).filter("event = 'onboarded'")
    return onboarded.groupBy("user_phone").agg(F.count("*").alias("contacts"))


@query("select cast(user_id as varchar) as user_phone, count(*) as contacts from (select distinct user_id from events) group by 1")
def first_contacts(spark, d):
    onboarded = jobs.replay(_inbound(spark, d)).filter("event = 'onboarded'")
    return onboarded.groupBy("user_phone").agg(F.count("*").alias("contacts"))


@query("""
select cast(user_id as varchar) as user_phone, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute, count(*) as messages,
  count(*) > 1 as over_limit, count(*) > 2 as over_burst from events group by 1, 2""")
def message_rates(spark, d):
    e = VW.table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_phone"), F.col("ts").alias("wa_received_at"))
    return jobs.rate_per_minute(e, 1, 2).select("user_phone", _stamp("minute"), "messages", "over_limit", "over_burst")


# Events at 1,440 times their pace, so that the buckets of one token a minute run dry.
@query("""
with recursive paced as (
  select cast(user_id as varchar) as user_phone, cast(event_id as varchar) as m, cast(floor(epoch_ms(ts) / 1440) as bigint) as moment from events),
line as (select *, row_number() over (partition by user_phone order by moment, m) as k from paced),
walk as (
  select user_phone, m, moment, k, true as passed, cast(180000 - 60000 as bigint) as level from line where k = 1
  union all
  select user_phone, m, moment, k, level >= 60000, case when level >= 60000 then level - 60000 else level end
  from (select l.*, least(180000, w.level + (l.moment - w.moment) * 1) as level from walk w join line l on l.user_phone = w.user_phone and l.k = w.k + 1))
select user_phone, m as wa_message_id, passed, cast(level // 60000 as bigint) as tokens from walk""")
def throttled_messages(spark, d):
    e = VW.table(spark, d, "events")
    paced = F.timestamp_millis(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1440).cast("bigint"))
    messages = e.select(F.col("user_id").cast("string").alias("user_phone"), F.col("event_id").cast("string").alias("wa_message_id"), paced.alias("wa_received_at"))
    return LM.throttled(messages, 1, 3).select("user_phone", "wa_message_id", "passed", "tokens")


# --- reports ----------------------------------------------------------------


# The ledger after two rounds of corrections: every ninth bill undone, every tenth amount doubled.
_CORRECTED = LEDGER + """,
corrected as (select * replace (case when bill_id % 10 = 0 then cast(2 * amount as decimal(18,2)) else amount end as amount,
    coalesce(category, 'misc') as category) from logged where bill_id % 9 <> 0)
"""


def _running_sums(spark, d):
    """The ledger in eight batches, then the undone bills, then the corrected ones."""
    # Eleven batches read the ledger, so its joins are run once.
    bills = cut_lineage(A.logged(VW.ledger(spark, d)).select("bill_id", "business_id", "confirmed_at", "category", "vendor", "type", "status", "amount", "gst", "auto_logged"))
    key, sign = F.col("bill_id"), lambda df, n: df.withColumn("sign", F.lit(n))
    store = TO.RunningSums(spark, f"{shared_folder(spark)}/sums-{uuid.uuid4().hex}", fanout=4)
    for k in range(8):
        store.add(sign(bills.filter(key % 8 == k), 1), k)
    store.add(sign(bills.filter(key % 9 == 0), -1), 8)
    wrong = bills.filter((key % 10 == 0) & (key % 9 != 0))
    right = wrong.withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)"))
    store.add(sign(wrong, -1).unionByName(sign(right, 1)), 9)
    return store.sums()


@query(_CORRECTED + """
select 'all' as kind, '' as name, count(*) as bills, cast(coalesce(sum(amount), 0) as double) as amount from corrected
union all select 'category', category, count(*), cast(sum(amount) as double) from corrected where amount is not null group by category
union all (select 'vendor', vendor, count(*), cast(sum(amount) as double) from corrected where amount is not null and vendor is not null group by vendor)
union all select 'day', strftime(confirmed_at, '%Y-%m-%d'), count(*), cast(sum(amount) as double) from corrected where amount is not null group by 2
union all select 'month', strftime(confirmed_at, '%Y-%m'), 0, 0.0 from corrected group by 2""")
def totals_from_sums(spark, d):
    sums = _running_sums(spark, d)
    zero = [F.lit(0).cast("bigint").alias("bills"), F.lit(0.0).alias("amount")]
    out = TO.totals(sums).select(F.lit("all").alias("kind"), F.lit("").alias("name"), "bills", "amount")
    for by in ("category", "vendor", "day"):
        out = out.unionByName(TO.spend(sums, by).select(F.lit(by).alias("kind"), F.col(by).alias("name"), "bills", "amount"))
    return out.unionByName(TO.options(sums).filter("kind = 'month'").select("kind", F.col("value").alias("name"), *zero))


@query(LEDGER + """,
asked as (select c_custkey as user_id, unnest(range(c_custkey * 10, c_custkey * 10 + 6)) as request_id from customer),
least as (select o_custkey as user_id, '$' || format('{:,.2f}', cast(cast(min(o_totalprice) as decimal(18,2)) as double)) as amount from orders group by 1),
worded as (select *, case request_id % 10 when 0 then ['rent'] when 1 then ['march'] when 2 then ['widqet'] when 3 then ['misc', 'jan'] when 4 then ['idge', '2'] else [amount] end as words
  from asked left join least using (user_id)),
fit as (select w.request_id, l.bill_id, l.confirmed_at from worded w join logged l using (user_id)
  where len(list_filter(w.words, lambda x: not (x in (coalesce(l.category, 'misc'), lower(strftime(l.confirmed_at, '%B')), lower(strftime(l.confirmed_at, '%b')), cast(month(l.confirmed_at) as varchar), strftime(l.confirmed_at, '%Y-%m'))
    or coalesce(try_cast(replace(replace(x, '$', ''), ',', '') as decimal(18,2)) = l.amount, false) or contains(lower(coalesce(l.vendor, '')), x)
    or len(list_filter(string_split_regex(lower(coalesce(l.vendor, '')), '[^a-z0-9]+'), lambda v: v = x or (length(v) >= 4 and length(x) >= 4 and levenshtein(v, x) <= 1))) > 0))) = 0)
select request_id, row_number() over (partition by request_id order by confirmed_at desc, bill_id desc) as rank, bill_id from fit
qualify rank <= 5""")
def search_requests(spark, d):
    # Each user asks the same five things, and for the amount of their smallest order.
    texts = F.array(*map(F.lit, ("find rent", " March ", "show widqet", "misc, jan", "find idge 2")), F.concat(F.lit("show $"), F.format_number("amount", 2)))
    least = VW.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_totalprice").cast("decimal(18,2)").alias("amount"))
    asked = VW.table(spark, d, "customer").select("c_custkey").join(least, "c_custkey", "left").select(F.col("c_custkey").alias("user_id"), F.posexplode(texts).alias("pos", "text"))
    asked = asked.select("user_id", (F.col("user_id") * 10 + F.col("pos")).alias("request_id"), "text")
    return LO.search_requests(asked, LO.index_bills(VW.ledger(spark, d)))

_MEMBERS_SQL = """
members as (select cast(c_nationkey as bigint) as business_id, c_custkey as user_id,
  case when c_custkey = min(c_custkey) over (partition by c_nationkey) then 'owner' else 'staff' end as role from customer)
"""


def _members(spark, d):
    people = VW.table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("business_id"), F.col("c_custkey").alias("user_id"))
    owners = people.groupBy("business_id").agg(F.min("user_id").alias("owner"))
    role = F.when(F.col("user_id") == F.col("owner"), "owner").otherwise("staff")
    return people.join(owners, "business_id").select("business_id", "user_id", role.alias("role"))


# Perth is UTC+8 all year in these years, so plain SQL can shift the clock.
_SUMMARY = LEDGER + "," + _MEMBERS_SQL + """,
local as (select *, strftime(confirmed_at + interval 8 hour, '%Y-%m-%d') as day, coalesce(category, 'misc') as cat from logged),
summary as (select m.user_id as viewer, l.business_id, day, type, cat as category, count(*) as bills, sum(amount) as amount
  from local l join members m on m.business_id = l.business_id and (m.role = 'owner' or m.user_id = l.user_id) group by all)
"""


@query(_SUMMARY + "select viewer, business_id, day, type, category, bills, cast(coalesce(amount, 0) as double) as amount from summary")
def daily_summary(spark, d):
    return _summary(spark, d)


def _summary(spark, d):
    zones = VW.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("business_id"), F.lit("Australia/Perth").alias("timezone"))
    return R.daily_summary(VW.ledger(spark, d), _members(spark, d), zones)


@query(_SUMMARY + """
select viewer, business_id, day, cast(coalesce(sum(amount) filter (type = 'incoming'), 0) as double) as incoming,
  cast(coalesce(sum(amount) filter (type = 'outgoing'), 0) as double) as outgoing,
  cast(coalesce(sum(amount) filter (type = 'incoming'), 0) - coalesce(sum(amount) filter (type = 'outgoing'), 0) as double) as net
from summary group by 1, 2, 3""")
def daily_net(spark, d):
    return R.daily_net(_summary(spark, d))


@query(LEDGER + """
select user_id, bill_id, vendor, rank from (select *, row_number() over (partition by user_id order by confirmed_at desc, bill_id desc) as rank
from logged where contains(vendor, 'old') or levenshtein(split_part(vendor, ' ', 1), 'old') <= 1 or levenshtein(split_part(vendor, ' ', 2), 'old') <= 1) where rank <= 5""")
def search_bills(spark, d):
    return R.search(VW.ledger(spark, d), "old").select("user_id", "bill_id", "vendor", "rank")


@query(LEDGER + """
, q as (select business_id, year(confirmed_at) || '-Q' || quarter(confirmed_at) as quarter, coalesce(vendor, 'unknown') as party, type, gst from logged where gst is not null)
select business_id, quarter, coalesce(party, 'all') as party, cast(coalesce(sum(gst) filter (type = 'incoming'), 0) as double) as collected,
  cast(coalesce(sum(gst) filter (type = 'outgoing'), 0) as double) as paid, count(*) as bills
from q group by grouping sets ((business_id, quarter, party), (business_id, quarter))""")
def tax_quarters(spark, d):
    return R.tax_quarters(VW.ledger(spark, d))


@query(LEDGER + """
select user_id, bill_id, rank from (select *, row_number() over (partition by user_id order by confirmed_at desc, bill_id desc) as rank
from logged where category = 'utilities' and month(confirmed_at) = 8) where rank <= 5""")
def search_two_words(spark, d):
    return R.search(VW.ledger(spark, d), "show August utilities").select("user_id", "bill_id", "rank")


@query(LEDGER + """
, q as (select business_id, year(confirmed_at) || '-Q' || quarter(confirmed_at) as quarter,
  case when bill_id % 4 = 0 then 'unknown' else cast(51824753550 + bill_id % 7 as varchar) end as party, type, gst from logged where gst is not null)
select business_id, quarter, coalesce(party, 'all') as party, cast(coalesce(sum(gst) filter (type = 'incoming'), 0) as double) as collected,
  cast(coalesce(sum(gst) filter (type = 'outgoing'), 0) as double) as paid, count(*) as bills
from q group by grouping sets ((business_id, quarter, party), (business_id, quarter))""")
def tax_by_abn(spark, d):
    key = F.col("bill_id")
    abn = F.when(key % 4 != 0, (F.lit(51824753550) + key % 7).cast("string"))
    return R.tax_quarters(VW.ledger(spark, d).withColumn("abn", abn), "abn")


@query(LEDGER + f"""
select bill_id, case when cast(confirmed_at as date) + 30 < date '{AS_OF[:10]}' then 'overdue' else 'due_soon' end as alert
from ledger where status = 'logged' and cast(confirmed_at as date) + 30 <= date '{AS_OF[:10]}' + 3""")
def due_alerts(spark, d):
    bills = VW.ledger(spark, d).withColumn("due_date", F.date_add(F.to_date("confirmed_at"), 30))
    return R.due_alerts(bills, _ts(AS_OF)).select("bill_id", "alert")


@query("""
select 'rule/' || c_custkey || '/' || strftime(p, '%Y-%m') as payment_id, c_custkey as user_id, strftime(p, '%Y-%m-%d') as pay_day
from (select c_custkey, unnest(generate_series(timestamp '2024-01-01' + interval 1 day * (c_custkey % 28), timestamp '2024-06-15', interval 1 month)) as p from customer)""")
def recurring_payments(spark, d):
    key = F.col("c_custkey")
    rules = VW.table(spark, d, "customer").select(
        key.alias("rule_id"), key.alias("user_id"), F.lit("Homebase").alias("vendor"), F.col("c_acctbal").alias("amount"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 28).cast("int")).alias("first_day"),
    )
    return R.expand_recurring(rules, _ts("2024-06-15 00:00:00")).select("payment_id", "user_id", "pay_day")


@query(LEDGER + """
select strftime(s.day, '%Y-%m-%d') as day, cast(coalesce(sum(amount) filter (type = 'incoming'), 0) as double) as incoming,
  cast(coalesce(sum(amount) filter (type = 'outgoing'), 0) as double) as outgoing
from (select unnest(generate_series(date '1998-01-01', date '1998-12-31', interval 1 day)) as day) s
left join logged on cast(confirmed_at as date) = cast(s.day as date) group by 1""")
def cash_flow(spark, d):
    return R.cash_flow(VW.ledger(spark, d), _ts("1998-01-01 00:00:00"), _ts("1998-12-31 00:00:00"))


@query("""
with b as (select event_id, user_id, ts, date_trunc('second', ts) as created, ts + interval 1 second * (event_id % 50) as confirmed,
  case event_type when 'purchase' then 'logged' when 'click' then 'paid' when 'error' then 'deleted' else 'draft' end as status from events)
select strftime(date_trunc('week', confirmed), '%Y-%m-%d') as week, count(*) as bills, count(*) filter (event_id % 2 = 0) / cast(count(*) as double) as auto_log_rate,
  count(*) filter (status = 'deleted') / cast(count(*) as double) as undo_rate, count(distinct user_id) as users,
  count(*) / cast(count(distinct user_id) as double) as bills_per_user, quantile_cont(epoch(date_trunc('second', confirmed)) - epoch(created), 0.5) as median_seconds
from b where status <> 'draft' group by 1""")
def kpis(spark, d):
    kind, key = F.col("event_type"), F.col("event_id")
    status = F.when(kind == "purchase", "logged").when(kind == "click", "paid").when(kind == "error", "deleted").otherwise("draft")
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (key % 50).cast("int"))
    bills = VW.table(spark, d, "events").select(
        F.col("user_id").alias("user_phone"), status.alias("status"), (key % 2 == 0).alias("auto_logged"),
        F.col("ts").alias("created_at"), (F.col("ts") + wait).alias("confirmed_at"),
    )
    return R.kpis(bills)


@query(LEDGER + """
select business_id, strftime(confirmed_at, '%Y') as year, count(amount) as bills, quantile_cont(cast(amount * 100 as bigint), 0.5) as median_cents, count(distinct user_id) filter (amount is not null) as users
from logged where amount is not null group by 1, 2""")
def median_bills(spark, d):
    cents = (F.col("amount") * 100).cast("long").alias("cents")
    bills = A.logged(VW.ledger(spark, d)).filter("amount is not null").select("business_id", F.date_format("confirmed_at", "yyyy").alias("year"), "user_id", cents)
    keys = ["business_id", "year"]
    found = M.exact_median(bills, keys, "cents").join(M.exact_distinct(bills, keys, "user_id"), keys)
    return found.select(*keys, F.col("n").alias("bills"), F.col("median").alias("median_cents"), F.col("different").alias("users"))


@query("select strftime(ts, '%Y-%m-%d') as day, count(distinct user_id) as users from events group by 1")
def daily_users(spark, d):
    e = VW.table(spark, d, "events").select(F.col("user_id").alias("user_phone"), F.col("ts").alias("wa_received_at"))
    return R.daily_users(e)


@query("""
select user_id as user_phone, event_id as wa_message_id, i - 1 as pos, 'img' || (i - 1) as image_url,
  case when i = 1 then 'awaiting_confirm' else 'queued' end as flow_state
from (select *, unnest(range(1, event_id % 4 + 2)) as i from events where event_type = 'purchase')""")
def queued_images(spark, d):
    key = F.col("event_id")
    urls = F.transform(F.sequence(F.lit(0).cast("bigint"), key % 4), lambda i: F.concat(F.lit("img"), i.cast("string")))
    messages = VW.table(spark, d, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").alias("user_phone"), key.alias("wa_message_id"), F.col("ts").alias("created_at"), urls.alias("image_urls")
    )
    return R.queue_images(messages).select("user_phone", "wa_message_id", "pos", "image_url", "flow_state")


@query(LEDGER + "," + _MEMBERS_SQL + """
select m.user_id as viewer, bill_id, l.business_id from ledger l
join members m on m.business_id = l.business_id and (m.role = 'owner' or m.user_id = l.user_id)""")
def visible_bills(spark, d):
    return R.visible_bills(VW.ledger(spark, d), _members(spark, d)).select("viewer", "bill_id", "business_id")


@query(LEDGER + "," + _MEMBERS_SQL + """,
who as (select min(user_id) as id from members where role = 'owner' and business_id = 3)
select bill_id, business_id from ledger l, who
where user_id = who.id or business_id in (select business_id from members, who where role = 'owner' and user_id = who.id)""")
def bills_of_viewer(spark, d):
    members = _members(spark, d)
    owner = members.filter("role = 'owner' and business_id = 3").agg(F.min("user_id").alias("id"))
    return R.bills_of_viewer(VW.ledger(spark, d), members, owner.scalar()).select("bill_id", "business_id")


@query(LEDGER + "select bill_id, business_id from ledger where business_id = 3")
def shared_bills(spark, d):
    key = F.col("n_nationkey").cast("bigint")
    links = VW.table(spark, d, "nation").select(
        key.alias("business_id"), F.concat(F.lit("t"), (key % 20).cast("string")).alias("token"),
        F.when(key < 20, _ts("2030-01-01 00:00:00")).otherwise(_ts("2001-01-01 00:00:00")).alias("expires_at"),
    )
    return R.shared_bills(VW.ledger(spark, d), links, "t3", _ts(AS_OF)).select("bill_id", "business_id")


# --- stored drafts, lists and zones -----------------------------------------


@query("""
select 'd' || o_orderkey as bill_id,
  strftime(case when o_orderkey % 3 = 0 then o_orderdate else o_orderdate + interval 2 hour end, '%Y-%m-%d %H:%M:%S') as confirmed_at,
  case when read and o_orderkey % 7 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as date,
  case when read then 'Shop ' || o_orderkey % 20 end as vendor,
  case when read and o_orderkey % 4 = 0 then 'Store ' || o_orderkey % 20 end as vendor_resolved_to,
  case when read and o_orderkey % 5 <> 0 then o_orderpriority else 'misc' end as category,
  case when read then o_totalprice end as amount,
  case when read and o_orderkey % 2 = 1 then cast(o_custkey as double) end as gst,
  case when read then case when o_orderkey % 2 = 1 then 'printed' else 'none' end end as gst_basis,
  case when read then 'INV-' || o_orderkey end as invoice_number,
  case when read and o_orderkey % 2 = 0 then '5' || o_custkey end as abn,
  o_orderkey % 6 = 1 as auto_logged, o_orderstatus as gate_level
from (select *, o_orderkey % 11 <> 0 as read from orders)""")
def flat_drafts(spark, d):
    """Drafts written as the stored table, read back by its schema and laid flat."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    made = F.col("o_orderdate").cast("timestamp")

    def read(value):
        return F.struct(value, F.lit(0.9))

    raw = F.struct(
        read(F.col("o_totalprice")), read(F.when(key % 7 != 0, V.day_key(made))), read(F.concat(F.lit("Shop "), (key % 20).cast("string"))),
        read(F.when(key % 4 == 0, F.concat(F.lit("Store "), (key % 20).cast("string")))), read(F.when(key % 2 == 0, F.concat(F.lit("5"), F.col("o_custkey").cast("string")))),
        read(F.when(key % 2 == 1, F.col("o_custkey").cast("double"))), F.when(key % 2 == 1, "printed").otherwise("none"),
        read(F.concat(F.lit("INV-"), text)), read(F.lit(None).cast("string")), read(F.when(key % 5 != 0, F.col("o_orderpriority"))),
    )
    stored = VW.table(spark, d, "orders").select(
        F.concat(F.lit("d"), text).alias("id"), F.lit("photo").alias("type"), F.array().cast("array<string>").alias("image_urls"),
        F.when(key % 11 != 0, raw).cast(EXTRACTION).alias("raw_extraction"), F.col("o_orderstatus").alias("gate_level"),
        F.when(key % 6 == 1, True).when(key % 6 != 0, False).alias("auto_logged"), F.lit("logged").alias("status"),
        made.alias("created_at"), F.when(key % 3 != 0, made + F.expr("interval 2 hours")).alias("confirmed_at"),
    )
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    stored.write.parquet(f"{folder}/transactions")
    return A.flatten_draft(readers.read_drafts(spark, folder)).withColumn("confirmed_at", _stamp("confirmed_at"))


@query("""
select event_id, case when event_id % 5 >= 3 then 2 else 0 end as n,
  case when event_id % 5 = 3 then event_type || '|' || user_id when event_id % 5 = 4 then 'a "b"|' || event_type else '' end as items
from events""")
def decoded_lists(spark, d):
    key, kind = F.col("event_id"), F.col("event_type")
    text = F.when(key % 5 == 0, F.concat(F.lit('["'), kind)).when(key % 5 == 2, "[]")
    text = text.when(key % 5 == 3, F.format_string('["%s", "%s"]', kind, F.col("user_id").cast("string"))).when(key % 5 == 4, F.format_string('["a \\"b\\"", "%s"]', kind))
    items = V.decode_list(text)
    return VW.table(spark, d, "events").select("event_id", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


@query("""
select c_custkey, case c_custkey % 10 when 0 then 'Australia/Sydney' when 1 then 'Australia/Sydney' when 2 then 'Australia/Perth'
  when 3 then 'Australia/Brisbane' when 4 then 'Australia/Hobart' when 5 then 'Australia/Darwin' when 6 then 'Australia/Adelaide'
  when 7 then 'Australia/Sydney' end as zone from customer""")
def city_zones(spark, d):
    cities = F.array(*map(F.lit, [" Sydney", "MELBOURNE", "perth\n", "Brisbane ", "hoBart", "darwin", "\tAdelaide", "Canberra", "perth road", ""]))
    zone = V.city_zone(F.get(cities, (F.col("c_custkey") % 10).cast("int")))
    return VW.table(spark, d, "customer").select("c_custkey", zone.alias("zone"))
