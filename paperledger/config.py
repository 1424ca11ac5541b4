"""Thresholds and time limits shared by every job.

All values are plain numbers with defaults; an override that is not a number
falls back to the default instead of failing the job.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    # Confidence thresholds per field.
    amount_high: float = 0.90
    amount_low: float = 0.70
    date_high: float = 0.85
    date_low: float = 0.60
    vendor_high: float = 0.75
    vendor_low: float = 0.50
    # Draft life cycle.
    draft_minutes: int = 10
    nudge_delay_minutes: int = 6
    undo_auto_hours: int = 24
    undo_confirm_minutes: int = 5
    # Look-back of the duplicate gate and window of the per-bill delete.
    duplicate_days: int = 90
    delete_hours: int = 2

    @property
    def nudge_window_minutes(self) -> int:
        return self.draft_minutes - self.nudge_delay_minutes

    @classmethod
    def from_overrides(cls, overrides: Mapping[str, str | None]) -> "Settings":
        """Build settings from text overrides, ignoring the unreadable ones."""
        kept = {}
        for f in fields(cls):
            number = _number(overrides.get(f.name))
            if number is not None:
                # f.type is a string because of the annotations import.
                kept[f.name] = math.floor(number + 0.5) if f.type == "int" else number
        return cls(**kept)


def _number(text: str | None) -> float | None:
    if text is None:
        return None
    if text.strip() == "":
        return 0.0
    try:
        value = float(text)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


DEFAULTS = Settings()
