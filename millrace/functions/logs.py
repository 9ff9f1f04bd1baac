"""Column rules and literals for log queries."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Log levels, lowest first.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")

_UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def since_bound(text: str | None, now: datetime) -> datetime | None:
    """``30m``, ``1h``, ``2d``, ``1w`` before ``now``, or an ISO time (UTC if it names no zone)."""
    if not text or not text.strip():
        return None
    text = text.strip()
    relative = re.fullmatch(r"(\d+)([mhdw])", text)
    if relative:
        return now - timedelta(**{_UNITS[relative[2]]: int(relative[1])})
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"not a time bound: {text!r}") from None
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def level_at_least(level: str, column: str = "level") -> Column:
    """Rows at a known level or above it; an unknown level must match exactly."""
    name = level.upper()
    if name in LEVELS:
        return F.col(column).isin(*LEVELS[LEVELS.index(name):])
    return F.col(column) == level


def under_tag(prefix: str, column: str = "tag", strict: bool = False) -> Column:
    """A tag below ``prefix``; unless ``strict``, the tag ``prefix`` itself too."""
    stem = prefix.rstrip(":")
    below = F.col(column).startswith(stem + ":")
    return below if strict else below | (F.col(column) == stem)


def contains_text(text: str, *columns: str) -> Column:
    """Case-insensitive literal substring in any of the columns."""
    needle = F.lower(F.lit(text))
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
    return found
