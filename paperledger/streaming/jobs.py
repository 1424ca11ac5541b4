"""The draft life cycle as a stream, and its exact batch replay."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperledger.config import DEFAULTS, Settings
from paperledger.functions.values import city_zone, compute_gst, gate_from, normalise_date, parse_amount, strip, unit_length
from paperledger.streaming.drafts import BILL_KEYS, DRAFT_FIELDS, MINUTE, Conversation

_DRAFT = "amount double, amount_conf double, date string, date_conf double, vendor string, gst_basis string, gst_registered boolean, invoice_number string"
_BILL_NAMES = ["at", "auto", *BILL_KEYS]
_BILL_FIELDS = "at: bigint, auto: boolean, vendor: string, amount: double, invoice_number: string"
#: In place of a step: settings came for a user who hasn't written yet.
_STRANGER = "stranger"
_TYPES = [T.DoubleType(), T.DoubleType(), T.StringType(), T.DoubleType(), T.StringType(), T.StringType(), T.BooleanType(), T.StringType()]
_STATE = ["message", "created", "active", "nudged", "flow_state", *DRAFT_FIELDS]
STEP_SCHEMA = T.StructType(
    [
        T.StructField("user_phone", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("draft_id", T.StringType()),
        T.StructField("flow_state", T.StringType()),
        *[T.StructField(name, kind) for name, kind in zip(DRAFT_FIELDS, _TYPES)],
        T.StructField("auto", T.BooleanType()),
        T.StructField("duplicate_of", T.StringType()),
        T.StructField("setting", T.StringType()),
        T.StructField("setting_value", T.StringType()),
    ]
)
MESSAGE_COLUMNS = ["user_phone", "message", "at", "kind", "text", "images", "auto_ok", *DRAFT_FIELDS,
                   "image", "auto_save", "auto_save_at", "gst_registered_at", "edit_amount", "edit_vendor", "edit_date", "edit_zone"]


#: What a message may carry beside its reading, and what it is where the column is missing.
_OPTIONAL = {"gst_registered": "boolean", "invoice_number": "string", "image": "int", "auto_save": "boolean", "auto_save_at": "timestamp", "gst_registered_at": "timestamp"}


def prepare(messages: DataFrame) -> DataFrame:
    """Normalised messages with a graded reading to the columns a step needs.

    Expected: user_phone, wa_message_id, wa_received_at, kind, text, images,
    auto_ok and the draft fields. May be there: ``image``, the number of the
    image that this row's reading is of (a message of several images is then
    several rows); ``auto_save`` and ``gst_registered`` as they are for this
    message, with the moments since when (``settings_as_of``). Rows of kind
    ``setting`` change them from their moment on for the same user. Typed
    corrections are validated here, as columns.
    """
    text = strip(F.col("text"))
    for name, kind in _OPTIONAL.items():
        if name not in messages.columns:
            messages = messages.withColumn(name, F.lit(None).cast(kind))
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return messages.select(
        "user_phone",
        F.col("wa_message_id").alias("message"),
        "wa_received_at",
        millis("wa_received_at").alias("at"),
        "kind",
        "text",
        F.col("images").cast("int").alias("images"),
        F.coalesce("auto_ok", F.lit(False)).alias("auto_ok"),
        *DRAFT_FIELDS,
        F.col("image").cast("int").alias("image"),
        "auto_save",
        millis("auto_save_at").alias("auto_save_at"),
        millis("gst_registered_at").alias("gst_registered_at"),
        parse_amount(text).alias("edit_amount"),
        F.when((text != "") & (unit_length(text) <= 60), text).alias("edit_vendor"),
        normalise_date(text).alias("edit_date"),
        city_zone(text).alias("edit_zone"),
    )


def finish(steps: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Grade and tax of every emitted draft, as columns."""
    graded = gate_from(
        F.col("amount"),
        F.col("amount_conf"),
        F.col("date"),
        F.col("date_conf"),
        F.col("vendor"),
        F.lit(settings.amount_high),
        F.lit(settings.amount_low),
        F.lit(settings.date_high),
    )
    return steps.select(
        "user_phone",
        F.timestamp_millis("at").alias("at"),
        "event",
        "draft_id",
        "flow_state",
        "amount",
        "date",
        "vendor",
        F.when(F.col("amount_conf").isNotNull(), graded).alias("gate"),
        compute_gst(F.col("amount"), F.col("gst_basis"), F.coalesce("gst_registered", F.lit(True))).alias("gst"),
        "auto",
        "invoice_number",
        "duplicate_of",
        "setting",
        "setting_value",
    )


def _plain(row: dict) -> dict:
    return {k: None if v is None or v != v else v for k, v in row.items()}


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=STEP_SCHEMA.names)
    return frame.astype({"auto": "object", "gst_registered": "object"})


_ORDER = ["at", "message", "image"]


def _known(users: DataFrame | None, messages: DataFrame) -> DataFrame:
    """``user_phone, known, step``: who needs no first contact, and where their set-up stands."""
    if users is None:
        return messages.sparkSession.createDataFrame([], "user_phone string, known boolean, step string")
    step = F.col("setup_step") if "setup_step" in users.columns else F.lit(None).cast("string")
    return users.groupBy("user_phone").agg(F.lit(True).alias("known"), F.max(F.when(step.isin("name", "timezone", "gst"), step)).alias("step"))


def replay(messages: DataFrame, settings: Settings = DEFAULTS, chunk_hours: int | None = None, users: DataFrame | None = None) -> DataFrame:
    """All steps of a static message table, as the stream would emit them.

    Rows stream through each task in time order; no group is held whole. With
    the duplicate gate, whether a bill is logged depends on all earlier ones of
    its user, so a user is one time line, of which a task keeps the bills of the
    last 90 days. ``chunk_hours`` leaves the gate out and cuts a user's time
    into chunks that run in parallel. What a chunk then needs from the past is
    bounded: drafts live ten minutes and an undo reaches back a day, and in both
    the newest entry is decided before older ones. So each chunk first replays
    that much of the time before it and emits nothing for it. Set-up answers
    and settings that the user's own messages change reach further: they need
    the whole time line, so chunks are for tables without them.

    ``users`` are those known before the first message (``user_phone``, maybe
    ``setup_step``): their first message is no first contact.
    """
    gate = chunk_hours is None
    chunk = (chunk_hours or 24 * 366 * 10_000) * 60 * MINUTE
    warmup = (settings.undo_auto_hours * 60 + 2 * settings.draft_minutes) * MINUTE
    contact = F.col("kind") != "setting"
    prepared = prepare(messages)
    firsts = prepared.filter(contact).groupBy("user_phone").agg(F.min(F.struct(*_ORDER)).alias("__first"))
    flagged = prepared.join(firsts, "user_phone", "left").join(_known(users, messages), "user_phone", "left").withColumn(
        "first", F.coalesce(contact & F.col("known").isNull() & F.struct(*_ORDER).eqNullSafe(F.col("__first")), F.lit(False))
    )
    part = lambda at: F.floor(at / chunk).cast("bigint")
    spread = flagged.withColumn("chunk", F.explode(F.sequence(part(F.col("at")), part(F.col("at") + warmup))))
    ordered = (
        spread.select("chunk", "first", "step", *MESSAGE_COLUMNS)
        .repartition("user_phone", "chunk")
        .sortWithinPartitions("user_phone", "chunk", "at", contact, "message", "image")  # a change acts on messages of its own moment
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, talk = None, None

        def kept(rows: list[dict]) -> list[dict]:
            low = current[1] * chunk
            return [r for r in rows if low <= r["at"] < low + chunk]

        for batch in batches:
            rows: list[dict] = []
            for m in map(_plain, batch.to_dict("records")):
                key = (m["user_phone"], m["chunk"])
                if key != current:
                    if talk is not None:
                        talk.advance((current[1] + 1) * chunk - 1)
                        rows += kept(talk.take())
                        if len(rows) >= 10_000:
                            yield _frame(rows)
                            rows = []
                    current, talk = key, Conversation(key[0], settings, gate, step=m["step"])
                talk.handle(m, bool(m["first"]))
                rows += kept(talk.take())
            yield _frame(rows)
        if talk is not None:
            talk.advance((current[1] + 1) * chunk - 1)
            yield _frame(kept(talk.take()))

    return finish(ordered.mapInPandas(run, STEP_SCHEMA), settings)


class StateHistory:
    """As ``History``, over keyed state: a message reads the entries of its own keys, and no others.

    ``held`` has, for each key, the bills of the last 90 days with it; ``day``
    is the list of the bills of the last day. ``ending`` says which keys to
    look after when a bill's time is over.
    """

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "kind string, name string, amount double", "at array<bigint>, draft_id array<string>")
        self.recent = handle.getValueState("recent", f"bills array<struct<draft_id: string, {_BILL_FIELDS}>>")
        self.ending = handle.getMapState("ending", "moment bigint", "kind array<string>, name array<string>, amount array<double>")
        self.moments: list[int] = []
        self.life = 0

    def _bills(self, key: tuple) -> list[tuple[int, str]]:
        return list(zip(*self.held.getValue(key))) if self.held.containsKey(key) else []

    def _keep(self, key: tuple, bills: list[tuple[int, str]]) -> None:
        if bills:
            self.held.updateValue(key, tuple(list(c) for c in zip(*bills)))
        else:
            self.held.removeKey(key)

    def newest(self, key: tuple, since: int) -> str | None:
        found = max(self._bills(key), default=None)
        return found[1] if found is not None and found[0] >= since else None

    def day(self, since: int) -> list[dict]:
        rows = self.recent.get()[0] if self.recent.exists() else []
        return [dict(zip(["draft_id", *_BILL_NAMES], r)) for r in rows if r[1] >= since]

    def add(self, bill: dict, keys: list[tuple], since: int) -> None:
        self._set_day([*self.day(bill["at"] - self.life), bill])
        for key in keys:
            self._keep(key, [*(b for b in self._bills(key) if b[0] >= since), (bill["at"], bill["draft_id"])])
        moment = 2 * bill["at"] - since + 1
        old = list(zip(*self.ending.getValue((moment,)))) if self.ending.containsKey((moment,)) else []
        entries = [*old, *keys]
        if entries:
            self.ending.updateValue((moment,), tuple(list(c) for c in zip(*entries)))
            self.moments.append(moment)

    def drop(self, bill: dict, keys: list[tuple]) -> None:
        self._set_day([b for b in self.day(0) if b != bill])
        for key in keys:
            self._keep(key, [b for b in self._bills(key) if b != (bill["at"], bill["draft_id"])])

    def _set_day(self, bills: list[dict]) -> None:
        if bills:
            self.recent.update(([tuple(b[n] for n in ["draft_id", *_BILL_NAMES]) for b in bills],))
        else:
            self.recent.clear()

    def forget(self, moment: int, life: int) -> None:
        """A bill's time is over at this moment: its keys lose what is older than ``life``."""
        if self.ending.containsKey((moment,)):
            for key in zip(*self.ending.getValue((moment,))):
                if self.held.containsKey(key):
                    self._keep(key, [b for b in self._bills(key) if b[0] >= moment - life])
            self.ending.removeKey((moment,))


class DraftProcessor(StatefulProcessor):
    """Keyed state of the stream: open drafts, bills by key, set-up step and settings."""

    def __init__(self, settings: Settings = DEFAULTS) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.drafts = handle.getMapState(
            "drafts",
            "draft_id string",
            f"message string, created bigint, active bigint, nudged boolean, flow_state string, {_DRAFT}",
        )
        self.history = StateHistory(handle)
        self.history.life = self.settings.undo_auto_hours * 60 * MINUTE
        # Whether the user is known, the step of the set-up, and the settings that changed with their moments.
        self.user = handle.getValueState("user", "step string, rules string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in map(_plain, initialState.to_dict("records")):
            self.user.update((row["step"], "{}"))

    def _load(self, user: str) -> Conversation:
        talk = Conversation(user, self.settings, history=self.history)
        for key, value in self.drafts.iterator():
            talk.drafts.append({"draft_id": key[0], **dict(zip(_STATE, value))})
        self.loaded = {d["draft_id"]: tuple(d[n] for n in _STATE) for d in talk.drafts}
        self.known = self.user.exists()
        if self.known:
            talk.step, rules = self.user.get()
            talk.rules = {name: tuple(rule) for name, rule in json.loads(rules).items()}
            self.known = talk.step != _STRANGER
            talk.step = talk.step if self.known else None
        return talk

    def _store(self, talk: Conversation, now: int) -> None:
        for d in talk.drafts:
            value = tuple(d[n] for n in _STATE)
            if self.loaded.get(d["draft_id"]) != value:  # entries that didn't change are not written again
                self.drafts.updateValue((d["draft_id"],), value)
        for gone in set(self.loaded) - {d["draft_id"] for d in talk.drafts}:
            self.drafts.removeKey((gone,))
        if self.known or talk.rules:
            self.user.update((talk.step if self.known else _STRANGER, json.dumps(talk.rules)))
        # All of them at once: one registered while timers fire waits for the next batch.
        for moment in {*talk.timers(), *self.history.moments}:
            if moment > now:
                self.handle.registerTimer(moment)
        self.history.moments.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        talk = self._load(key[0])
        pending = [m for frame in rows for m in frame.to_dict("records")]
        for m in sorted(map(_plain, pending), key=lambda m: (m["at"], m["kind"] != "setting", m["message"] or "", -1 if m["image"] is None else m["image"])):
            first = not self.known and m["kind"] != "setting"
            self.known = self.known or first
            talk.handle(m, first)
        self._store(talk, timerValues.getCurrentWatermarkInMs())
        yield _frame(talk.take())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        talk = self._load(key[0])
        moment = expiredTimerInfo.getExpiryTimeInMs()
        talk.advance(moment)
        self.history.forget(moment, talk.bill_life)
        self._store(talk, moment)
        yield _frame(talk.take())

    def close(self) -> None:
        pass


def draft_stream(messages: DataFrame, settings: Settings = DEFAULTS, lateness: str = "10 minutes", users: DataFrame | None = None) -> DataFrame:
    """The life cycle of drafts over a stream of messages.

    A retried delivery meets the live-draft check of the step itself: while the
    draft is open it is a retry, and once it is decided the message counts anew.
    ``users``, known before the stream begins, are the initial state. Changes of
    settings may run in the same stream, as rows of kind ``setting``.
    """
    timed = messages.withColumn("wa_received_at", F.col("wa_received_at").cast("timestamp"))
    prepared = prepare(timed.withWatermark("wa_received_at", lateness)).select("wa_received_at", *MESSAGE_COLUMNS)
    steps = prepared.groupBy("user_phone").transformWithStateInPandas(
        statefulProcessor=DraftProcessor(settings),
        outputStructType=STEP_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
        initialState=None if users is None else _known(users, messages).groupBy("user_phone"),
    )
    return finish(steps, settings)


def rate_per_minute(messages: DataFrame, limit: int = 30, burst: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Messages per user and minute with both limits; works on streams and tables.

    A stream gives a minute's count once the watermark has passed it.
    """
    timed = messages.withColumn("wa_received_at", F.col("wa_received_at").cast("timestamp"))
    timed = timed.withWatermark("wa_received_at", lateness) if messages.isStreaming else timed
    minute = F.window("wa_received_at", "1 minute")
    counted = timed.groupBy("user_phone", minute).agg(F.count("*").alias("messages"))
    return counted.select(
        "user_phone",
        F.col("window.start").alias("minute"),
        "messages",
        (F.col("messages") > limit).alias("over_limit"),
        (F.col("messages") > burst).alias("over_burst"),
    )
