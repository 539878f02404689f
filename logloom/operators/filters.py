"""Event search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_events(events: DataFrame, now: Column, tenant_id: int | None = None, source_id: int | None = None, status: str | None = None,
                  minutes: int = 0, text: str | None = None) -> DataFrame:
    """Events by tenant, source, status, age and a text anywhere in the line, case ignored.

    Every condition is a plain filter, so tenant and day prune partitions and the rest is pushed to the scan. As in a
    LIKE pattern, '%' and '_' in the text stand for any text and any character.
    """
    if tenant_id is not None:
        events = events.filter(F.col("tenant_id") == tenant_id)
    if source_id is not None:
        events = events.filter(F.col("source_id") == source_id)
    if status in ("parsed", "unparsed", "received"):
        events = events.filter(F.col("status") == status)
    if minutes:
        events = events.filter(F.col("received_at") > now - F.expr(f"interval {int(minutes)} minutes"))
    if text:
        events = events.filter(F.col("raw").ilike(f"%{text}%"))
    return events
