"""Small builders shared by the tests."""

from datetime import datetime, timedelta, timezone

BASE = datetime(2026, 6, 4, 9, 0, 0, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return BASE + timedelta(seconds=seconds)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by(df, key="event_id"):
    return {r[key]: r for r in rows(df)}
