"""The guard's rule for one key: points add up, fade while it is quiet, and from a threshold on lead to a ban that ends.

A quiet key loses FADE points each time another interval has passed since its last event; when no more than FADE are
left it is forgotten. Both follow from the time since the last event, so nothing happens between events but at one known
time: when a key is forgotten, or a ban ends. Streams set a timer for it, batches look at the next event.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

FADE, THRESHOLD = 2, 10
INTERVAL_S, DAY_S = 300, 86400
LOGINS = 5

SCHEMA = "user_id long, at long, kind string, score long, until long"


class State(NamedTuple):
    """Points, logins and attacks so far, time of the last event, end of the ban (0: none)."""

    score: int = 0
    logins: int = 0
    attacks: int = 0
    last: int = 0
    until: int = 0

    def ends(self, interval: int) -> int:
        """When the key is forgotten, or its ban is over, if nothing comes in."""
        return (self.until if self.until else self.last + interval * -(-self.score // FADE)) + 1

    def end(self, interval: int) -> tuple[int, str, int, int]:
        return (self.ends(interval), "release" if self.until else "forget", self.score, self.until)

    def event(self, at: int, points: int, kind: str, interval: int) -> State:
        """After an event that comes before the end."""
        score = self.score if self.until else max(self.score - FADE * max((at - self.last - 1) // interval, 0), 0)
        new = State(score + points, self.logins + (kind == "login"), self.attacks + (kind == "error"), at, self.until)
        if new.until or new.score < THRESHOLD:
            return new
        days = 7 if new.logins >= LOGINS else 2 if new.attacks else 1
        return new._replace(until=at + days * DAY_S)


def follow(state: State | None, at: int, points: int, kind: str, interval: int) -> tuple[State, list[tuple[int, str, int, int]]]:
    """The state after an event, and the changes (time, kind, score, end of ban) up to it."""
    changes = []
    if state and state.ends(interval) <= at:
        changes.append(state.end(interval))
        state = None
    # an event that is late for its key counts at the time of the last one
    new = state.event(max(at, state.last), points, kind, interval) if state else State(last=at).event(at, points, kind, interval)
    if new.until and not (state and state.until):
        changes.append((new.last, "ban", new.score, new.until))
    return new, changes


def guard_changes(events: DataFrame, as_of: int, interval: int = INTERVAL_S) -> DataFrame:
    """user_id, at, kind (ban, release, forget), score, until of all changes up to a time.

    events: user_id, epoch, event_id, event_type, points. Keys are dealt to tasks and sorted there, and each task goes
    through its rows batch by batch with the state of one key, so a key with very many events needs no memory. Events
    without points or key don't count."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def last() -> list[tuple]:
            return [(key, *state.end(interval))] if state and state.ends(interval) <= as_of else []

        for pdf in batches:
            out = []
            for user, at, kind, points in zip(pdf["user_id"], pdf["epoch"], pdf["event_type"], pdf["points"], strict=True):
                if user != key:
                    out += last()
                    key, state = user, None
                state, changes = follow(state, at, points, kind, interval)
                out += [(key, *c) for c in changes]
            yield pd.DataFrame(out, columns=["user_id", "at", "kind", "score", "until"])
        yield pd.DataFrame(last(), columns=["user_id", "at", "kind", "score", "until"])

    rows = events.where(f"points > 0 and user_id is not null and epoch <= {as_of}").select("user_id", "epoch", "event_id", "event_type", "points")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "epoch", "event_id").mapInPandas(walk, SCHEMA)
