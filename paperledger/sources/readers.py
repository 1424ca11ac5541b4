"""Sources: raw messages, label folders, ledger tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.schemas import DRAFT_COLUMNS, LABEL, TABLES


#: Texts of a message and where they are in it.
_PARTS = {"from": "from", "id": "id", "timestamp": "timestamp", "type": "type", "body": "text.body", "image": "image.id"}


def _read_parts(raw: DataFrame, column: str) -> DataFrame:
    """Add the texts of each payload's message. A payload is parsed once and each text is looked up once, in projections of their own.

    Only the first message of the first change of the first entry counts. Values
    of the wrong JSON type are refused, hence VARIANT and its type checks.
    """
    first = F.try_variant_get(F.try_parse_json(F.col(column)), "$.entry[0].changes[0].value.messages[0]", "variant")
    kept = [f"`{c}`" for c in raw.columns if c != column]
    found = raw.select(*kept, first.alias("__message"))
    found = found.select(*kept, *[F.try_variant_get("__message", f"$.{path}", "variant").alias(f"__{n}") for n, path in _PARTS.items()])
    text = lambda n: F.when(F.schema_of_variant(f"__{n}") == "STRING", F.try_variant_get(f"__{n}", "$", "string"))
    return found.select(*kept, *[text(n).alias(f"__{n}") for n in _PARTS])


def _message() -> Column:
    """The parts as a normalised message struct, or null for anything else."""
    part = {n: F.col(f"__{n}") for n in _PARTS}
    epoch = F.coalesce(F.nullif(F.trim(part["timestamp"]), F.lit("")), F.lit("0")).try_cast("double")
    kind, body, image = part["type"], part["body"], part["image"]
    usable = F.when(kind == "text", body.isNotNull()).when(kind == "image", image.isNotNull())
    message = F.struct(
        part["from"].alias("user_phone"),
        part["id"].alias("wa_message_id"),
        F.timestamp_micros((epoch * 1000000).cast("bigint")).alias("wa_received_at"),
        F.when(kind == "image", "photo").otherwise("text").alias("kind"),
        F.when(kind == "image", F.array(image)).alias("image_urls"),
        F.when(kind == "text", body).alias("text"),
        F.lit(None).cast("string").alias("ocr_text"),
    )
    return F.when((part["from"] != "") & (part["id"] != "") & usable, message)


def inbound_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Usable messages of a table or stream of raw payloads."""
    kept = [f"`{c}`" for c in raw.columns if c != column]
    return _read_parts(raw, column).select(*kept, F.inline(F.array_compact(F.array(_message()))))


def read_message_stream(spark: SparkSession, folder: str) -> DataFrame:
    return inbound_messages(spark.readStream.text(folder))


def check_labels(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split label rows into usable and quarantined ones and fill the defaults."""
    shape = F.col("orientation").isNull() | F.col("orientation").isin("portrait", "landscape")
    ok = F.coalesce(F.col("id") != "", F.lit(False)) & F.col("should_log").isNotNull() & shape
    filled = raw.withColumns(
        {
            "kind": F.when(F.col("kind") == "text", "text").otherwise("image"),
            "hard": F.coalesce("hard", F.lit(False)),
        }
    )
    return filled.filter(ok), filled.filter(~ok)


def read_labels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document per label file. A label's own ``source`` becomes ``label_source``: extraction adds a ``source``."""
    raw = spark.read.schema(LABEL).json(folder, multiLine=True, pathGlobFilter="*.json")
    return check_labels(raw.withColumn("file", F.col("_metadata.file_name")).withColumnRenamed("source", "label_source"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A typed ledger table; drafts and ledger jobs read a pruned projection."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def read_drafts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "transactions").select(*DRAFT_COLUMNS)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names under a folder without their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -2).alias("dir"),
        F.regexp_extract(name, r"\A(.*)\.[^.]*\z", 1).alias("id"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)).alias("ext"),
    )


def read_spread(spark: SparkSession, path: str, row_group: int = 128 << 20) -> DataFrame:
    """A Parquet table whose rows cost far more to work on than to move, such as texts for the extraction rules.

    A task reads whole row groups, so a table of fewer groups than cores leaves
    cores idle. Only then are its rows dealt out anew; ``row_group`` is the size
    that a group has in a large file. A table with files enough is read as it is.
    """
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    groups = files.agg(F.sum(F.ceil(F.col("length") / row_group))).head()[0] or 0
    return rows.repartition(cores) if groups < cores else rows
