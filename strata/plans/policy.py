"""What may be shown of a dataset: all of it (open), or only what enough rows share (private)."""

from __future__ import annotations

from strata.operators.profile import FLOOR

MODES = ("private", "open")


def mode_of(value) -> str:
    """A mode; anything unknown is private."""
    return value if value in MODES else "private"


def combined(modes: list[str]) -> str:
    """A session is as open as its most private dataset."""
    return "open" if modes and all(mode_of(m) == "open" for m in modes) else "private"


def too_rare(n: int, mode: str) -> bool:
    return mode_of(mode) == "private" and n < FLOOR


def correlation_allowed(n: int, mode: str) -> bool:
    return not too_rare(n, mode)


def filter_floor(shown: int, total: int, mode: str) -> str:
    """ok, too-few-shown, or too-few-excluded: a filter may isolate neither few rows nor all but few."""
    if too_rare(shown, mode):
        return "too-few-shown"
    return "too-few-excluded" if total > shown and too_rare(total - shown, mode) else "ok"
