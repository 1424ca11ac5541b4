"""What one message or one passing minute does to one user's drafts.

The stream and the batch replay both drive this small step helper; Spark
partitions, orders and delivers the rows. Value checks, grading and tax are done
as columns before and after it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from paperledger.config import DEFAULTS, Settings

DRAFT_FIELDS = ["amount", "amount_conf", "date", "date_conf", "vendor", "gst_basis", "gst_registered", "invoice_number"]
EDITS = {"2": "amount", "3": "vendor", "5": "date"}
COMMANDS = {"help", "setup", "autosave on", "autosave off"}
MINUTE = 60_000


BILL_KEYS = ["vendor", "amount", "invoice_number"]
#: Which step of the set-up follows which, and the setting each one gives.
SETUP = {"name": ("business_name", "timezone"), "timezone": ("timezone", "gst"), "gst": ("gst_registered", None)}
#: Settings a message of kind ``setting`` or a command can change, and that later messages meet.
RULES = ["auto_save", "gst_registered"]


def bill_keys(bill: dict) -> list[tuple[str, str, float]]:
    """What makes another bill a copy of this one; a missing value matches nothing."""
    keys = []
    if bill["invoice_number"] is not None:
        keys.append(("invoice", bill["invoice_number"], 0.0))
    if bill["vendor"] is not None and bill["amount"] is not None:
        keys.append(("pair", bill["vendor"], float(bill["amount"])))
    return keys


class History:
    """Logged bills of one user by key, and those of the last day in order; held in memory.

    The stream has the same four methods over its keyed state.
    """

    def __init__(self) -> None:
        self.held: dict[tuple, list[tuple[int, str]]] = {}
        self.recent: list[dict] = []

    def newest(self, key: tuple, since: int) -> str | None:
        """The newest bill with this key, not older than ``since``."""
        found = max(self.held.get(key, ()), default=None)
        return found[1] if found is not None and found[0] >= since else None

    def day(self, since: int) -> list[dict]:
        """The bills since a moment within the last day."""
        self.recent = [b for b in self.recent if b["at"] >= since]
        return self.recent

    def add(self, bill: dict, keys: list[tuple], since: int) -> None:
        """Keep a bill; of its keys, what is older than ``since`` is forgotten."""
        self.recent.append(bill)
        for key in keys:
            kept = [b for b in self.held.get(key, ()) if b[0] >= since]
            self.held[key] = [*kept, (bill["at"], bill["draft_id"])]

    def drop(self, bill: dict, keys: list[tuple]) -> None:
        self.recent.remove(bill)
        for key in keys:
            left = [b for b in self.held.get(key, ()) if b != (bill["at"], bill["draft_id"])]
            if left:
                self.held[key] = left
            else:
                self.held.pop(key, None)


@dataclass
class Conversation:
    """Open drafts, logged bills, set-up step and settings of one user; times in milliseconds.

    ``rules`` are the settings that changed so far: name to (moment, value).
    A change that came with a message's own columns (``auto_save_at``) gives
    way to a later one that the user's messages made. ``gate`` off logs copies
    like any other bill.
    """

    user: str
    settings: Settings = DEFAULTS
    gate: bool = True
    history: History = field(default_factory=History)
    drafts: list[dict] = field(default_factory=list)
    step: str | None = None
    rules: dict[str, tuple[int, bool]] = field(default_factory=dict)
    out: list[dict] = field(default_factory=list)
    resent: tuple | None = None

    def copy_of(self, draft: dict, now: int) -> str | None:
        """The logged bill that this draft repeats: same invoice, or same vendor and amount."""
        for key in bill_keys(draft) if self.gate else ():
            found = self.history.newest(key, now - self.bill_life)
            if found is not None:
                return found
        return None

    @property
    def bill_life(self) -> int:
        return self.settings.duplicate_days * 24 * 60 * MINUTE

    def rule(self, name: str, m: dict) -> bool:
        """What a setting is for this message: the later of the message's own and the user's own change, true if there is none."""
        given, at = m.get(name), m.get(f"{name}_at")
        own = self.rules.get(name)
        if own is not None and (at is None or own[0] >= at):
            return own[1]
        return True if given is None else bool(given)

    def _emit(self, at: int, event: str, draft: dict | None = None, **more) -> None:
        row = {"user_phone": self.user, "at": at, "event": event, "draft_id": None, "flow_state": None}
        row.update({f: None for f in DRAFT_FIELDS})
        row["auto"] = row["duplicate_of"] = row["setting"] = row["setting_value"] = None
        if draft is not None:
            row.update({k: draft[k] for k in ["draft_id", "flow_state", *DRAFT_FIELDS]})
        row.update(more)
        self.out.append(row)

    def take(self) -> list[dict]:
        rows, self.out = self.out, []
        return rows

    def advance(self, now: int) -> None:
        """Let time pass: remind and expire drafts up to and including ``now``."""
        due = []
        for d in self.drafts:
            # A draft that was queued at its time of reminder is reminded when it becomes active.
            remind_at = max(d["created"] + self.settings.nudge_delay_minutes * MINUTE, d["active"])
            waits = d["flow_state"] == "awaiting_confirm" or d["flow_state"].startswith("editing_")
            if waits and not d["nudged"] and remind_at <= now:
                d["nudged"] = True
                due.append((remind_at, 1, "nudged", d))
            if d["created"] + self.settings.draft_minutes * MINUTE <= now:
                due.append((d["created"] + self.settings.draft_minutes * MINUTE, 0, "expired", d))
        for at, _, event, d in sorted(due, key=lambda x: (x[0], x[1], x[3]["draft_id"])):
            self._emit(at, event, d if event == "nudged" else {**d, "flow_state": None})
            if event == "expired":
                self.drafts.remove(d)

    def timers(self) -> list[int]:
        """Every moment at which something happens to an open draft by itself."""
        s = self.settings
        reminders = [max(d["created"] + s.nudge_delay_minutes * MINUTE, d["active"]) for d in self.drafts]
        return reminders + [d["created"] + s.draft_minutes * MINUTE for d in self.drafts]

    def handle(self, m: dict, first: bool) -> None:
        """Apply one message, or one change of settings from elsewhere."""
        now = m["at"]
        self.advance(now)
        if m["kind"] == "setting":
            for name in RULES:
                if m.get(name) is not None:
                    self.rules[name] = (now, bool(m[name]))
            return
        if first:
            self._emit(now, "onboarded")
            if m["kind"] != "photo":
                return
        if m["kind"] == "photo":
            self._photo(m)
            return
        text = (m["text"] or "").strip().lower()
        if self.step is not None:  # the set-up goes before an open draft
            self._setup(text, m)
            return
        open_drafts = [d for d in self.drafts if d["flow_state"] != "queued"]
        if open_drafts:
            self._reply(max(open_drafts, key=lambda d: (d["created"], d["draft_id"])), text, m)
        elif text == "delete":
            self._undo(now)
        elif text == "next":
            self._promote(now)
        else:
            if text == "setup":
                self.step = "name"
            if text.startswith("autosave ") and text in COMMANDS:
                self.rules["auto_save"] = (now, text == "autosave on")
            self._emit(now, text if text in COMMANDS else "unknown")

    def _setup(self, text: str, m: dict) -> None:
        """One answer of the set-up: refused, or a setting and the next step."""
        name, following = SETUP[self.step]
        value = m["edit_vendor"] if self.step == "name" else m.get("edit_zone") if self.step == "timezone" else {"yes": "true", "no": "false"}.get(text)
        if value is None and text != "skip":
            self._emit(m["at"], "setup_refused", setting=name)
            return
        if name == "gst_registered" and text != "skip":
            self.rules[name] = (m["at"], value == "true")
        self.step = following
        self._emit(m["at"], "setup_done" if following is None else "setup_answer", setting=name, setting_value=None if text == "skip" else value)

    def _photo(self, m: dict) -> None:
        """The images of a message, or one of them if the message is dealt image by image (``image``)."""
        number = m.get("image")
        delivery = (m["message"], m["at"])
        if not number:
            self.resent = delivery if any(d["message"] == m["message"] for d in self.drafts) else None
            if self.resent:
                self._emit(m["at"], "retry")
        if self.resent == delivery:
            return
        for i in range(max(int(m.get("images") or 1), 1)) if number is None else [int(number)]:
            draft = {f: m.get(f) for f in DRAFT_FIELDS}
            draft["gst_registered"] = self.rule("gst_registered", m)
            draft.update(
                draft_id=f"{m['message']}/{i}",
                message=m["message"],
                created=m["at"],
                active=m["at"],
                nudged=False,
                flow_state="awaiting_confirm" if i == 0 else "queued",
            )
            self.drafts.append(draft)
            ready = i == 0 and m["auto_ok"] and self.rule("auto_save", m)
            copy = self.copy_of(draft, m["at"]) if ready else None
            if ready and copy is None:
                self._log(draft, m["at"], auto=True)
            else:
                self._emit(m["at"], draft["flow_state"], draft, duplicate_of=copy)

    def _log(self, draft: dict, at: int, auto: bool) -> None:
        self.drafts.remove(draft)
        bill = {"draft_id": draft["draft_id"], "at": at, "auto": auto, **{f: draft[f] for f in BILL_KEYS}}
        self.history.add(bill, bill_keys(bill), at - self.bill_life)
        self._emit(at, "auto_logged" if auto else "confirmed", {**draft, "flow_state": None}, auto=auto)

    def _reply(self, draft: dict, text: str, m: dict) -> None:
        now = m["at"]
        if draft["flow_state"].startswith("editing_"):
            name = draft["flow_state"].removeprefix("editing_")
            value = m[f"edit_{name}"]
            if value is None:
                self._emit(now, "edit_refused", draft)
                return
            draft[name] = value
            if name != "vendor":
                draft[f"{name}_conf"] = 1.0
            draft["flow_state"] = "awaiting_confirm"
            self._emit(now, "edited", draft)
        elif text == "1":
            self._log(draft, now, auto=False)
        elif text in EDITS:
            draft["flow_state"] = f"editing_{EDITS[text]}"
            self._emit(now, "editing", draft)
        elif text == "4":
            self.drafts.remove(draft)
            self._emit(now, "skipped", {**draft, "flow_state": None})
        elif text == "next":
            self._promote(now)
        else:
            if text == "setup":
                self.step = "name"
            self._emit(now, text if text in ("help", "setup") else "unclear", draft)

    def _promote(self, now: int) -> None:
        queued = [d for d in self.drafts if d["flow_state"] == "queued"]
        if not queued:
            self._emit(now, "queue_empty")
            return
        oldest = min(queued, key=lambda d: (d["created"], d["draft_id"]))
        oldest["flow_state"], oldest["active"] = "awaiting_confirm", now
        self._emit(now, "promoted", oldest)

    def _undo(self, now: int) -> None:
        s = self.settings
        recent = self.history.day(now - s.undo_auto_hours * 60 * MINUTE)
        if not recent:
            self._emit(now, "undo_nothing")
            return
        newest = max(recent, key=lambda b: (b["at"], b["draft_id"]))
        limit = s.undo_auto_hours * 60 * MINUTE if newest["auto"] else s.undo_confirm_minutes * MINUTE
        if newest["at"] < now - limit:
            self._emit(now, "undo_too_late", draft_id=newest["draft_id"])
            return
        self.history.drop(newest, bill_keys(newest))
        self._emit(now, "undone", draft_id=newest["draft_id"])
