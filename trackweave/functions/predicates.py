"""Named predicates. "Active" has three meanings, so it has three names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States by purpose.
ACTIVE_FOR_DEDUPE = ["queued", "downloading", "processing", "completed"]
ACTIVE_IN_LIST = ["queued", "downloading"]
ACTIVE_IN_CLIENT = ["downloading", "processing"]
RETRYABLE = ["failed", "cancelled"]
CANCELLABLE = ["queued", "downloading"]
DELETABLE = ["completed", "cancelled", "failed"]
CANCELLABLE_JOBS = ["pending", "processing"]


def has_status(status: Column, wanted: str | None) -> Column:
    """Equality; nothing wanted, or an empty string, means no filter."""
    return status == wanted if wanted else F.lit(True)


def matches_pattern(term: str, *columns: Column) -> Column:
    """Case-insensitive search in any column; ``%`` and ``_`` in the term are wildcards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(c.ilike(f"%{term}%"), F.lit(False))
    return found


def contains_text(term: str, *columns: Column) -> Column:
    """Case-insensitive search for the term as it stands, blanks included; only blanks mean no filter."""
    if not term.strip():
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term.lower()))
    return found


def checked_page(limit: int, offset: int, most: int) -> None:
    if not 0 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 0 to {most} and offset 0 or more, not {limit} and {offset}")


def checked_deletable(status: str) -> None:
    if status not in DELETABLE:
        raise ValueError(f"only {', '.join(DELETABLE)} rows can be deleted, not {status}")
