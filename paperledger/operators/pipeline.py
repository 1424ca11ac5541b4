"""From messages to ledger rows: reading, tenant, duplicate gate, draft life cycle, fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperledger.config import DEFAULTS, Settings
from paperledger.operators.extract import extract_bills
from paperledger.operators.ledger import enrich_with_business, settings_as_of
from paperledger.plans.lineage import cut_lineage
from paperledger.streaming import jobs


RULES = ["auto_save", "gst_registered"]


def deal_images(messages: DataFrame, readings: dict[str, str]) -> DataFrame:
    """A row for each image of a message, with its number ``image``; other messages stay one row.

    ``readings`` names array columns with an entry for each image, and the
    columns that each row's own entry goes to.
    """
    zipped = F.arrays_zip("image_urls", *readings)
    kept = [c for c in messages.columns if c not in readings.values()]
    dealt = messages.select(*kept, F.posexplode_outer(zipped).alias("image", "entry"))
    return dealt.select(*[c for c in kept if c not in readings], "image", *[F.col("entry")[source].alias(name) for source, name in readings.items()])


def read_photos(messages: DataFrame, users: DataFrame, businesses: DataFrame, settings: Settings = DEFAULTS, changes: DataFrame | None = None, **answers: Column) -> DataFrame:
    """Messages with what the life cycle needs: the draft fields, ``auto_ok`` and the tenant's settings.

    Works on tables and streams alike: tenants are joined as tables, and the
    rules are columns. ``answers`` are the stored answers of ``extract_bills``.
    ``changes`` of the settings over time (``business_id, ts, change_id`` and
    the fields) are for tables; a stream has them as rows of kind ``setting``.
    """
    photo = F.col("kind") == "photo"
    known = enrich_with_business(messages, users, businesses)
    if changes is not None:
        known = settings_as_of(known, changes, "business_id", RULES)
    read = extract_bills(known, ocr_text=F.when(photo, F.col("ocr_text")), registered=F.col("gst_registered"), settings=settings, **answers)
    e = F.col("extraction")
    only = lambda c: F.when(photo, c)
    return read.select(
        "user_phone",
        "wa_message_id",
        "wa_received_at",
        "kind",
        "text",
        F.size("image_urls").alias("images"),
        *(["image"] if "image" in messages.columns else []),
        F.coalesce(photo & (F.col("gate") == "high") & ~F.col("machine_read"), F.lit(False)).alias("auto_ok"),
        *RULES,
        *([f"{rule}_at" for rule in RULES] if changes is not None else []),
        *[only(e[f]["value"]).alias(f) for f in ("amount", "date", "vendor", "invoice_number")],
        *[only(e[f]["confidence"]).alias(f"{f}_conf") for f in ("amount", "date")],
        only(e["gst_basis"]).alias("gst_basis"),
    )


def setting_rows(changes: DataFrame, users: DataFrame, like: DataFrame) -> DataFrame:
    """Changes of a business's settings as rows for each of its users, to run in their streams; columns as in ``like``."""
    rows = changes.join(users.select("user_phone", "business_id"), "business_id").select(
        "user_phone", F.concat(F.lit("setting-"), F.col("change_id").cast("string")).alias("wa_message_id"),
        F.col("ts").cast("timestamp").alias("wa_received_at"), F.lit("setting").alias("kind"), *RULES,
    )
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns])


def fold_steps(steps: DataFrame) -> DataFrame:
    """One ledger row for each time a draft was logged; ``deleted`` if its next step undid that."""
    decisions = steps.filter(F.col("event").isin("confirmed", "auto_logged", "undone"))
    order = Window.partitionBy("user_phone", "draft_id").orderBy("at", F.col("event") == "undone")
    rows = decisions.withColumn("next", F.lead("event").over(order)).filter("event <> 'undone'")
    return rows.select(
        "user_phone",
        "draft_id",
        F.col("at").alias("confirmed_at"),
        F.when(F.col("next") == "undone", "deleted").otherwise("logged").alias("status"),
        F.coalesce("auto", F.lit(False)).alias("auto_logged"),
        F.col("amount").cast("decimal(18,2)").alias("amount"),
        F.col("gst").cast("decimal(18,2)").alias("gst"),
        "date",
        "vendor",
        "invoice_number",
        F.col("gate").alias("gate_level"),
    )


def ledger_from_messages(messages: DataFrame, users: DataFrame, businesses: DataFrame, settings: Settings = DEFAULTS, changes: DataFrame | None = None, **answers: Column) -> DataFrame:
    """Ledger rows of a message table; ``changes`` as in ``read_photos``."""
    # A message is dear to read, so messages are dealt out first, and read once for the first contacts and the drafts.
    dealt = messages.repartition("user_phone", "wa_message_id")
    read = cut_lineage(read_photos(dealt, users, businesses, settings, changes, **answers))
    return fold_steps(jobs.replay(read, settings, users=users))


def steps_from_stream(messages: DataFrame, users: DataFrame, businesses: DataFrame, settings: Settings = DEFAULTS, lateness: str = "10 minutes", changes: DataFrame | None = None, **answers: Column) -> DataFrame:
    """The steps of a message stream; ``fold_steps`` over what it wrote gives the ledger.

    ``changes``: a stream of settings that change, as in ``read_photos``. They
    run in the same keyed stream and act on the messages behind them.
    """
    read = read_photos(messages, users, businesses, settings, **answers)
    if changes is not None:
        read = read.unionByName(setting_rows(changes, users, read))
    return jobs.draft_stream(read, settings, lateness, users)
