"""Clocks. Every job takes its time from one, so that a replay decides as a live run does."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Protocol


def as_utc(moment: datetime) -> datetime:
    """Naive times are UTC; others are converted."""
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


class Clock(Protocol):
    def now(self) -> datetime: ...


class SystemClock:
    def now(self) -> datetime:
        return datetime.now(UTC)


class SimulatedClock:
    """Stands still until it is moved, and moves forward only."""

    def __init__(self, start: datetime):
        self._at = as_utc(start)

    def now(self) -> datetime:
        return self._at

    def advance_to(self, moment: datetime) -> None:
        self._at = max(self._at, as_utc(moment))
