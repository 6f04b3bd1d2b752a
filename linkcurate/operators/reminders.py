"""Reminder rows for job links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOOTER = "Generated by linkcurate"
# --- Fixed values: reminder window and alerts.
START_HOUR = 9
LENGTH_MINUTES = 30
ALERTS = [("popup", 15), ("email", 60)]


def reminder_start(now: Column) -> Column:
    """Nine o'clock on the next day."""
    return F.date_trunc("day", now) + F.expr(f"INTERVAL '1 {START_HOUR}' DAY TO HOUR")


def reminder_end(now: Column) -> Column:
    return reminder_start(now) + F.expr(f"INTERVAL {LENGTH_MINUTES} MINUTE")


def _moment(at: Column, zone: str) -> Column:
    return F.struct(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"), F.lit(zone).alias("timeZone")
    )


def job_reminders(
    items: DataFrame, now: Column | None = None, zone: str = "UTC", footer: str = FOOTER
) -> DataFrame:
    """One reminder per item of type `job` (`url, title, item_type, summary`)."""
    now = F.current_timestamp() if now is None else now
    body = F.concat(
        F.lit("Review Job Opportunity:\n\nTitle: "), F.col("title"),
        F.lit("\nURL: "), F.col("url"),
        F.lit("\nNotes: "), F.coalesce(F.col("summary"), F.lit("")),
        F.lit(f"\n\n---\n{footer}"),
    )
    alerts = F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(n).alias("minutes")) for m, n in ALERTS
    ])
    return items.filter(F.col("item_type") == "job").select(
        "url",
        F.concat(F.lit("💼 Review Job: "), F.col("title")).alias("summary"),
        body.alias("description"),
        _moment(reminder_start(now), zone).alias("start"),
        _moment(reminder_end(now), zone).alias("end"),
        F.struct(F.lit(False).alias("useDefault"), alerts.alias("overrides")).alias("reminders"),
    )
