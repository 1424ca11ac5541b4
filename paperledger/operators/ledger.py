"""Batch forms of the draft and ledger life cycle: lookups, patches, sweeps, undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperledger.config import DEFAULTS, Settings
from paperledger.functions.values import compute_gst, gate, normalise_date, parse_amount, strip, unit_length
from paperledger.schemas import DOMAINS, EDITING_STATES, EXTRACTION, LOGGED_STATUSES, empty_extraction


def _minutes(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def _hours(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def _newest(df: DataFrame, key: str, ts: str, row_id: str, value: Column) -> DataFrame:
    """Newest row per key; combines before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(ts, row_id)).alias("__n")).select(key, "__n.*")


def active_drafts(drafts: DataFrame, as_of: Column) -> DataFrame:
    """The newest unexpired draft of each user."""
    live = drafts.filter((F.col("status") == "draft") & (F.col("flow_expires_at") > as_of))
    fields = F.struct("id", "flow_state", "created_at", "flow_expires_at")
    return _newest(live, "user_phone", "created_at", "id", fields)


def check_domains(df: DataFrame, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``violations``: the columns whose value is outside its domain; null is allowed."""
    rules = {c: v for c, v in (domains or DOMAINS).items() if c in df.columns}
    bad = [F.when(~F.col(c).isin(values), F.lit(c)) for c, values in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*bad)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = check_domains(df)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def apply_patch(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Overwrite only the supplied (non-null) fields; unmatched patches do nothing."""
    fields = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"__p_{c}") for c in fields])
    merged = base.join(renamed, key, "left")
    return merged.select(
        *[F.coalesce(f"__p_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def latest_settings(changes: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """Last supplied value per field from a stream of partial changes."""
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, "change_id")))
    return changes.groupBy(key).agg(*[pick(c).alias(c) for c in fields])


def settings_as_of(messages: DataFrame, changes: DataFrame, key: str, fields: list[str], at: str = "wa_received_at", bucket_hours: int = 24) -> DataFrame:
    """Messages with each setting as it is at their moment: the last change before it, and ``<field>_at``, when that was.

    ``changes``: the key, ``ts``, ``change_id`` and the fields, null where a
    change leaves one alone; one at a message's own moment counts. A setting
    that nobody changed yet keeps the value of the message's own column, null
    if it has none. Messages without a key meet no change.

    A key's time line is cut into buckets. What holds when a bucket begins is
    found among one row for each bucket; inside it, messages and changes are
    sorted together. So a key with a third of all messages spreads over its days.
    """
    length = F.lit(bucket_hours * 3600)
    own = [c for c in messages.columns if c not in {f"{f}_at" for f in fields}]
    bucket = lambda ts: F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / length).alias("bucket")
    moment = lambda ts: F.unix_micros(F.col(ts).cast("timestamp"))
    value = lambda f: F.when(F.col(f).isNotNull(), F.struct(moment("ts").alias("at"), F.col("change_id").alias("tie"), F.col(f).alias("value"))).alias(f)
    made = changes.filter(F.col(key).isNotNull()).select(key, bucket("ts"), moment("ts").alias("at"), F.col("change_id").alias("tie"), *[value(f) for f in fields])
    asked = messages.filter(F.col(key).isNotNull()).select(key, bucket(at), moment(at).alias("at"), F.struct(*own).alias("row"))

    nothing = [F.lit(None).cast(made.schema[f].dataType).alias(f) for f in fields]
    steps = made.groupBy(key, "bucket").agg(*[F.max(f).alias(f) for f in fields]).unionByName(asked.select(key, "bucket").distinct().select(key, "bucket", *nothing))
    steps = steps.groupBy(key, "bucket").agg(*[F.max(f).alias(f) for f in fields])
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = steps.select(key, "bucket", *[F.last(f, ignorenulls=True).over(before).alias(f) for f in fields])

    row = F.lit(None).cast(asked.schema["row"].dataType).alias("row")
    line = (
        begun.select(key, "bucket", F.lit(None).cast("long").alias("at"), F.lit(0).alias("turn"), *fields, row)
        .unionByName(made.select(key, "bucket", "at", F.lit(0).alias("turn"), *fields, row))
        .unionByName(asked.select(key, "bucket", "at", F.lit(1).alias("turn"), *nothing, "row"))
    )
    # What began with the bucket has no moment, so it sorts first; of changes at one moment the largest struct is the last.
    sofar = Window.partitionBy(key, "bucket").orderBy("at", "turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = line.select("turn", "row", *[F.max(f).over(sofar).alias(f) for f in fields]).filter("turn = 1")
    found = met.select(
        *[F.coalesce(F.col(f"{c}.value"), F.col("row")[c]).alias(c) if c in fields else F.col("row")[c].alias(c) for c in own],
        *[F.col(f"{f}.value").alias(f) for f in fields if f not in own],
        *[F.timestamp_micros(F.col(f"{f}.at")).alias(f"{f}_at") for f in fields],
    )
    loose = messages.filter(F.col(key).isNull()).select(
        *own,
        *[F.lit(None).cast(changes.schema[f].dataType).alias(f) for f in fields if f not in own],
        *[F.lit(None).cast("timestamp").alias(f"{f}_at") for f in fields],
    )
    return found.unionByName(loose)


def confirm(drafts: DataFrame, confirmed_at: Column, auto: Column) -> DataFrame:
    """Turn drafts into logged rows and copy the extracted values to plain columns."""
    e = F.col("raw_extraction")
    value = lambda f: e[f]["value"]
    return drafts.withColumns(
        {
            "status": F.lit("logged"),
            "flow_state": F.lit(None).cast("string"),
            "confirmed_at": confirmed_at,
            "auto_logged": F.coalesce(auto, F.lit(False)),
            "amount": value("amount").cast("decimal(18,2)"),
            "gst": value("gst").cast("decimal(18,2)"),
            "category": F.coalesce(value("category_hint"), F.lit("misc")),
            "vendor": value("vendor"),
            "abn": value("abn"),
            "invoice_number": value("invoice_number"),
            "due_date": value("due_date").try_cast("date"),
        }
    )


def confirm_flags(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """What a confirm screen would mark, as columns: no wording."""
    e = F.col("extraction")
    value = lambda f: e[f]["value"]

    def doubtful(field: str, high: float) -> Column:
        return F.coalesce(value(field).isNotNull() & (e[field]["confidence"] < high), F.lit(False))

    date_doubt = doubtful("date", settings.date_high)
    return df.select(
        "*",
        F.when(F.col("machine_read"), "machine").when(F.col("gate") == "high", "high").otherwise("check").alias("header"),
        doubtful("amount", settings.amount_high).alias("verify_amount"),
        doubtful("vendor", settings.vendor_high).alias("verify_vendor"),
        date_doubt.alias("verify_date"),
        value("amount").isNull().alias("amount_missing"),
        value("vendor").isNull().alias("vendor_missing"),
        (value("date").isNull() | date_doubt).alias("offer_date_edit"),
        value("abn").isNull().alias("abn_unverified"),
    )


def enrich_with_business(events: DataFrame, users: DataFrame, businesses: DataFrame) -> DataFrame:
    """Add the tenant's settings; unknown users get the defaults."""
    tenant = users.select("user_phone", "business_id")
    rules = businesses.select("business_id", "gst_registered", "auto_save", "timezone")
    joined = events.join(tenant, "user_phone", "left").join(rules, "business_id", "left")
    return joined.select(
        *events.columns,
        "business_id",
        F.coalesce("gst_registered", F.lit(True)).alias("gst_registered"),
        F.coalesce("auto_save", F.lit(True)).alias("auto_save"),
        "timezone",
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key no live draft holds, one per key, first one wins."""
    live = existing.filter("status = 'draft'").select(*keys).distinct()
    fresh = incoming.join(live, keys, "left_anti")
    others = [c for c in incoming.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return fresh.groupBy(*keys).agg(first.alias("__f")).select(*keys, "__f.*")


def reload_seed(table: DataFrame, seed: DataFrame, user: str, prefix: str) -> DataFrame:
    """Replace one user's rows under an id prefix by the seed; safe to repeat."""
    seeded = (F.col("user_phone") == user) & F.col("wa_message_id").startswith(prefix)
    kept = table.filter(~F.coalesce(seeded, F.lit(False)))
    return kept.unionByName(seed.select(*table.columns))


def add_missing(dimension: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Insert-or-ignore for a dimension table."""
    new = rows.dropDuplicates(key).join(dimension.select(*key), key, "left_anti")
    return dimension.unionByName(new.select(*dimension.columns))


def expire_due(drafts: DataFrame, as_of: Column) -> DataFrame:
    """Flip drafts past their time limit to expired."""
    due = (F.col("status") == "draft") & (F.col("flow_expires_at") <= as_of)
    return drafts.withColumns(
        {
            "flow_state": F.when(~due, F.col("flow_state")),
            "status": F.when(due, "expired").otherwise(F.col("status")),
        }
    )


def _nudge_due(as_of: Column, settings: Settings) -> Column:
    window_end = as_of + _minutes(settings.nudge_window_minutes)
    return (
        (F.col("status") == "draft")
        & F.col("flow_nudged_at").isNull()
        & (F.col("flow_expires_at") > as_of)
        & (F.col("flow_expires_at") <= window_end)
        & F.col("flow_state").isin("awaiting_confirm", *EDITING_STATES)
    )


def nudge_due(drafts: DataFrame, as_of: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Open drafts in the last minutes of their life that were never reminded."""
    return drafts.filter(_nudge_due(as_of, settings))


def sweep(drafts: DataFrame, as_of: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """One sweep: expiry first, then reminders, as two counts."""
    # A row due to expire is past its limit, so it is never counted as nudged.
    expired = (F.col("status") == "draft") & (F.col("flow_expires_at") <= as_of)
    nudged = _nudge_due(as_of, settings)
    return drafts.agg(F.count_if(expired).alias("expired"), F.count_if(nudged).alias("nudged"))


def undo(bills: DataFrame, requests: DataFrame, user: str = "user_id", settings: Settings = DEFAULTS) -> DataFrame:
    """Answer each user's undo request against the newest bill of the last day.

    ``requests`` has the user and ``asked_at``, at most one row per user. An
    older bill is never searched for once the newest one is out of its window.
    """
    joined = bills.filter(F.col("status").isin(LOGGED_STATUSES)).join(requests, user)
    recent = joined.filter(
        (F.col("confirmed_at") <= F.col("asked_at"))
        & (F.col("confirmed_at") >= F.col("asked_at") - _hours(settings.undo_auto_hours))
    )
    target = F.struct("bill_id", "confirmed_at", "auto_logged")
    found = _newest(recent, user, "confirmed_at", "bill_id", target)
    answered = requests.join(found, user, "left")
    oldest = F.col("asked_at") - F.when(
        F.col("auto_logged"), _hours(settings.undo_auto_hours)
    ).otherwise(_minutes(settings.undo_confirm_minutes))
    return answered.select(
        user,
        "asked_at",
        "bill_id",
        F.when(F.col("bill_id").isNull(), "nothing")
        .when(F.col("confirmed_at") < oldest, "too_late")
        .otherwise("deleted")
        .alias("outcome"),
    )


def delete_requested(bills: DataFrame, requests: DataFrame, user: str = "user_id", n: int = 20, settings: Settings = DEFAULTS) -> DataFrame:
    """Bill ids a user may still delete: among the last ``n`` and under two hours old."""
    order = Window.partitionBy(user).orderBy(F.desc("confirmed_at"), F.desc("bill_id"))
    last = (
        bills.filter(F.col("status").isin(LOGGED_STATUSES))
        .select(user, "bill_id", "confirmed_at", F.row_number().over(order).alias("rank"))
        .filter(F.col("rank") <= n)
    )
    young = F.col("confirmed_at") >= F.col("asked_at") - _hours(settings.delete_hours)
    return last.join(requests, [user, "bill_id"]).filter(young).select(user, "bill_id", "confirmed_at")


def onboard(messages: DataFrame, users: DataFrame) -> DataFrame:
    """New users with the business and owner role each gets on first contact.

    Ids are derived from the phone number, so a repeated batch adds nothing new.
    """
    fresh = messages.groupBy("user_phone").agg(F.min("wa_received_at").alias("created_at"))
    fresh = fresh.join(users.select("user_phone"), "user_phone", "left_anti")
    made = lambda kind: F.substring(F.sha2(F.concat(F.lit(kind), F.col("user_phone")), 256), 1, 32)
    return fresh.select(
        "user_phone",
        made("business:").alias("business_id"),
        made("membership:").alias("membership_id"),
        F.lit("My Business").alias("name"),
        F.lit("Australia/Sydney").alias("timezone"),
        F.lit(True).alias("gst_registered"),
        F.lit(True).alias("auto_save"),
        F.lit("owner").alias("role"),
        "created_at",
    )


def route(messages: DataFrame, users: DataFrame, live: DataFrame) -> DataFrame:
    """Where each message goes: onboarding, photo, set-up, draft reply or command."""
    known = users.select("user_phone", "setup_step", F.lit(True).alias("known"))
    open_draft = live.select("user_phone", F.lit(True).alias("open")).distinct()
    joined = messages.join(known, "user_phone", "left").join(open_draft, "user_phone", "left")
    photo = F.col("kind") == "photo"
    return joined.select(
        *messages.columns,
        F.when(F.col("known").isNull() & ~photo, "onboard")
        .when(F.col("known").isNull(), "onboard_photo")
        .when(photo, "photo")
        .when(F.col("setup_step").isin("name", "timezone", "gst"), "setup")
        .when(F.col("open"), "reply")
        .otherwise("command")
        .alias("route"),
    )


def check_edits(edits: DataFrame) -> DataFrame:
    """Validate typed corrections: ``field`` and ``text`` to value or refusal."""
    text = strip(F.col("text"))
    name = F.when((text != "") & (unit_length(text) <= 60), text)
    return edits.select(
        "*",
        F.when(F.col("field") == "amount", parse_amount(text)).alias("amount_value"),
        F.when(F.col("field") == "vendor", name).alias("vendor_value"),
        F.when(F.col("field") == "date", normalise_date(text)).alias("date_value"),
    ).withColumn("accepted", F.coalesce(F.col("amount_value").cast("string"), "vendor_value", "date_value").isNotNull())


def apply_edits(drafts: DataFrame, edits: DataFrame, id_col: str = "id", settings: Settings = DEFAULTS) -> DataFrame:
    """Drafts after their typed corrections, with tax and grade as they are then.

    ``drafts``: ``extraction`` and ``gst_registered`` (null: registered);
    ``edits``: the draft's id, ``edited_at`` (anything that orders them),
    ``field`` and ``text``. The latest accepted correction of each field counts;
    refused ones change nothing. A typed amount brings its tax along, a typed
    vendor clears the name it was resolved to. ``gate`` is new where something
    was corrected, else it stays. A draft's edits are combined before they
    move, so a draft with very many of them is one row.
    """
    fields = {"amount": "amount_value", "vendor": "vendor_value", "date": "date_value"}
    latest = [F.max_by(v, F.when(F.col(v).isNotNull(), F.struct("edited_at", "text"))).alias(v) for v in fields.values()]
    last = check_edits(edits).filter("accepted").groupBy(id_col).agg(*latest).withColumn("corrected", F.lit(True))
    sure = lambda c: F.struct(c.alias("value"), F.lit(1.0).alias("confidence"))
    kept = lambda new, name, value: F.when(F.col(new).isNotNull(), value).otherwise(F.col("__x")[name])
    gst = compute_gst(F.col("amount_value"), F.col("__x.gst_basis"), F.coalesce("gst_registered", F.lit(True)))
    changed = {
        **{name: kept(new, name, sure(F.col(new))) for name, new in fields.items()},
        "gst": kept("amount_value", "gst", sure(gst)),
        "vendor_resolved_to": kept("vendor_value", "vendor_resolved_to", empty_extraction()["vendor_resolved_to"]),
    }
    joined = drafts.join(last, id_col, "left").withColumn("__x", F.coalesce("extraction", empty_extraction()))
    new = F.struct(*[changed.get(c, F.col("__x")[c]).alias(c) for c in EXTRACTION.names])
    done = joined.withColumn("extraction", F.when(F.col("corrected"), new).otherwise(F.col("extraction")))
    grade = F.when(F.col("corrected"), gate(F.col("extraction"), settings)).otherwise(F.col("gate"))
    return done.withColumn("gate", grade).select(*drafts.columns)
