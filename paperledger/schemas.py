"""Schemas and enum domains of the bill data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The allowed values of every enumerated column.
DOMAINS = {
    "type": ["incoming", "outgoing"],
    "category": ["wages", "utilities", "inventory", "rent", "misc"],
    "gate_level": ["high", "partial", "low"],
    "status": ["draft", "logged", "paid", "overdue", "expired", "deleted"],
    "flow_state": [
        "processing",
        "awaiting_confirm",
        "editing_amount",
        "editing_vendor",
        "editing_date",
        "queued",
    ],
    "payment_method": ["cash", "bank_transfer", "card", "bpay"],
    "role": ["owner", "staff"],
}

EDITING_STATES = ["editing_amount", "editing_vendor", "editing_date"]
LOGGED_STATUSES = ["logged", "paid"]

MONEY = T.DecimalType(18, 2)


def reading(value_type: T.DataType) -> T.StructType:
    """A value as read, with the confidence of the reading."""
    return T.StructType(
        [T.StructField("value", value_type), T.StructField("confidence", T.DoubleType())]
    )


STRING_FIELDS = [
    "date",
    "vendor",
    "vendor_resolved_to",
    "abn",
    "invoice_number",
    "due_date",
    "category_hint",
]
NUMBER_FIELDS = ["amount", "gst"]

EXTRACTION = T.StructType(
    [
        T.StructField("amount", reading(T.DoubleType())),
        T.StructField("date", reading(T.StringType())),
        T.StructField("vendor", reading(T.StringType())),
        T.StructField("vendor_resolved_to", reading(T.StringType())),
        T.StructField("abn", reading(T.StringType())),
        T.StructField("gst", reading(T.DoubleType())),
        T.StructField("gst_basis", T.StringType()),
        T.StructField("invoice_number", reading(T.StringType())),
        T.StructField("due_date", reading(T.StringType())),
        T.StructField("category_hint", reading(T.StringType())),
    ]
)


def empty_extraction() -> Column:
    """An extraction in which nothing was read."""
    nothing = lambda f: F.struct(F.lit(None).cast(f.dataType["value"].dataType).alias("value"), F.lit(0.0).alias("confidence"))
    return F.struct(*[(F.lit("none") if isinstance(f.dataType, T.StringType) else nothing(f)).alias(f.name) for f in EXTRACTION])


def _table(*columns: str | tuple[str, T.DataType]) -> T.StructType:
    """Columns are text unless typed; a trailing ``!`` marks a required one."""
    out = []
    for column in columns:
        name, kind = column if isinstance(column, tuple) else (column, T.StringType())
        out.append(T.StructField(name.rstrip("!"), kind, not name.endswith("!")))
    return T.StructType(out)


_TS, _BOOL = T.TimestampType(), T.BooleanType()

BUSINESSES = _table(
    "id!", "name!", "abn", "timezone!", ("gst_registered!", _BOOL), ("auto_save!", _BOOL), ("created_at!", _TS)
)
USERS = _table("phone_number!", "business_id", "setup_step", ("created_at!", _TS))
MEMBERSHIPS = _table("id!", "business_id!", "user_phone!", "role!", ("created_at!", _TS))
SHARE_LINKS = _table(
    "id!", "business_id!", "token!", "created_by", ("expires_at!", _TS), ("created_at!", _TS)
)
TRANSACTIONS = _table(
    "id!",
    "business_id",
    "user_phone",
    "type!",
    ("amount", MONEY),
    ("gst", MONEY),
    "category",
    "vendor",
    "abn",
    "invoice_number",
    ("due_date", T.DateType()),
    ("image_urls!", T.ArrayType(T.StringType())),
    ("raw_extraction", EXTRACTION),
    "gate_level",
    ("machine_read", _BOOL),
    ("auto_logged", _BOOL),
    "status!",
    "flow_state",
    ("flow_expires_at", _TS),
    ("flow_nudged_at", _TS),
    "wa_message_id",
    ("wa_received_at", _TS),
    "payment_method",
    ("created_at!", _TS),
    ("confirmed_at", _TS),
)

TABLES = {
    "businesses": BUSINESSES,
    "users": USERS,
    "memberships": MEMBERSHIPS,
    "share_links": SHARE_LINKS,
    "transactions": TRANSACTIONS,
}

# The columns the draft and ledger jobs read; scans prune to these.
DRAFT_COLUMNS = [
    "id",
    "user_phone",
    "wa_message_id",
    "flow_state",
    "flow_expires_at",
    "image_urls",
    "created_at",
    "status",
    "raw_extraction",
    "gate_level",
    "machine_read",
    "auto_logged",
    "confirmed_at",
    "flow_nudged_at",
]


INBOUND = T.StructType(
    [
        T.StructField("user_phone", T.StringType()),
        T.StructField("wa_message_id", T.StringType()),
        T.StructField("wa_received_at", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("image_urls", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("ocr_text", T.StringType()),
    ]
)

LABEL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ocr_text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("should_log", T.BooleanType()),
        T.StructField("orientation", T.StringType()),
        T.StructField("hard", T.BooleanType()),
        T.StructField("duplicate_of", T.StringType()),
        T.StructField(
            "expected",
            T.StructType(
                [
                    T.StructField("amount", T.DoubleType()),
                    T.StructField("date", T.StringType()),
                    T.StructField("vendor", T.StringType()),
                    T.StructField("gst", T.DoubleType()),
                    T.StructField("gst_basis", T.StringType()),
                    T.StructField("abn", T.StringType()),
                    T.StructField("invoice_number", T.StringType()),
                    T.StructField("due_date", T.StringType()),
                ]
            ),
        ),
    ]
)
