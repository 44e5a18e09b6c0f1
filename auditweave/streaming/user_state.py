"""Per-user feature state for the streaming features, run inside tasks."""

from __future__ import annotations

from collections import Counter, deque
from operator import itemgetter

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

DAY_US = 86_400_000_000
FEATURES = (
    "is_new_ip_for_user", "is_new_device_for_user", "api_call_count_1m", "error_rate_5m",
    "read_vs_write_ratio", "unique_resources_accessed", "unique_ips_last_24h",
    "privileged_actions_last_24h",
)
HISTORY = "at long, ok int, reading int, privileged int, resource string, ip string"
OUTPUT = (
    "event_id string, user_id string, is_new_ip_for_user int, is_new_device_for_user int, "
    "api_call_count_1m long, error_rate_5m double, read_vs_write_ratio double, "
    "unique_resources_accessed long, unique_ips_last_24h long, privileged_actions_last_24h long"
)


def _text(value):
    return None if value is None or value != value else str(value)


class Trailing:
    """Rows (at, ok, reading, privileged, resource, ip) of one trailing window and their sums.

    A row enters once and leaves once, whatever the number of rows in the window.
    """

    def __init__(self, us):
        self.us = us
        self.rows = deque()
        self.ok = self.reads = self.privileged = 0
        self.resources, self.ips = Counter(), Counter()

    def add(self, row):
        self.rows.append(row)
        self._count(row, 1)
        while self.rows[0][0] <= row[0] - self.us:
            self._count(self.rows.popleft(), -1)

    def _count(self, row, sign):
        self.ok += sign * row[1]
        self.reads += sign * row[2]
        self.privileged += sign * row[3]
        for seen, value in ((self.resources, row[4]), (self.ips, row[5])):
            seen[value] += sign
            if not seen[value]:
                del seen[value]


def featurize(minute, five, hour, day):
    """Trailing features after the newest row entered all four windows."""
    return (
        len(minute.rows),
        (len(five.rows) - five.ok) / len(five.rows),
        hour.reads / max(len(hour.rows) - hour.reads, 1),
        len(day.resources),
        len(day.ips),
        day.privileged,
    )


class UserFeatures(StatefulProcessor):
    """Trailing history (24 h) and first-seen sets of one user."""

    def __init__(self, ttl_ms):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.history = handle.getListState("history", HISTORY, ttlDurationMs=self.ttl_ms)
        self.seen_ip = handle.getMapState("seen_ip", "ip string", "at long")
        self.seen_device = handle.getMapState("seen_device", "device string", "at long")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"])
        history = sorted((tuple(h) for h in self.history.get()), key=itemgetter(0))
        windows = [Trailing(us) for us in (60_000_000, 300_000_000, 3_600_000_000, DAY_US)]
        out, done = [], 0
        for r in batch.itertuples(index=False):
            ip, resource = _text(r.source_ip), _text(r.resource)
            event = (int(r.at), int(r.ok), int(r.reading), int(r.privileged), resource, ip)
            while done < len(history) and history[done][0] <= event[0]:
                self._enter(windows, history[done])
                done += 1
            self._enter(windows, event)
            new_ip = self._first(self.seen_ip, ip or "", event[0])
            new_device = self._first(self.seen_device, r.device, event[0])
            out.append((str(r.event_id), key[0], new_ip, new_device, *featurize(*windows)))
        for row in history[done:]:
            self._enter(windows, row)
        self.history.put(list(windows[-1].rows))
        yield pd.DataFrame(out, columns=["event_id", "user_id", *FEATURES])

    @staticmethod
    def _enter(windows, row):
        for window in windows:
            window.add(row)

    @staticmethod
    def _first(seen, value, at):
        if seen.containsKey((value,)):
            return 0
        seen.updateValue((value,), (at,))
        return 1

    def close(self):
        pass
