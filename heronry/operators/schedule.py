"""Schedules as text, as jobs are given them: ``every 5 minutes``, ``at 10:15 am every weekday``, ``on the first day of the month``.

A clause is one of ``every N units``, ``every weekday|weekend|<day>``, ``at hh:mm[:ss] [am|pm]``, ``on the first|last|Nth day of the month``, ``on <day>``,
``after hh:mm``, ``before hh:mm``; clauses side by side must all hold, ``also`` starts another schedule, times may be listed with ``and``.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_DAY = "|".join(f"{d[:3]}(?:{d[3:]})?" for d in DAYS)
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm)?"
_CLAUSES = tuple(
    (kind, re.compile(rf"\s*{pattern}(?=\s|,|$)", re.I))
    for kind, pattern in (
        ("every", r"every\s+(?:(\d+)\s+)?(second|sec|minute|min|hour|day|week)s?"), ("weekday", r"every\s+weekday"), ("weekend", r"every\s+weekend"), ("on", rf"(?:every|on)\s+({_DAY})s?"), ("month day", r"on\s+the\s+(first|last|\d{1,2}(?:st|nd|rd|th)?)\s+day(?:\s+of\s+the\s+month)?"),
        ("at", rf"(?:at|and)\s+{_TIME}"), ("after", rf"after\s+{_TIME}"), ("before", rf"before\s+{_TIME}"), ("also", r"also"),
    )
)


@dataclass
class Schedule:
    seconds: int | None = None
    times: list[int] = field(default_factory=list)  # seconds of a day
    days: set[int] | None = None  # 0 is Monday
    month_day: int | None = None  # -1 is the last
    after: int = 0
    before: int = 86400

    def allows(self, t: datetime) -> bool:
        at = t.hour * 3600 + t.minute * 60 + t.second
        if self.days is not None and t.weekday() not in self.days:
            return False
        if self.month_day is not None and t.day != self.month_day and not (self.month_day == -1 and (t + timedelta(days=1)).day == 1):
            return False
        return self.after <= at < self.before

    def moments(self, start: datetime) -> Iterator[datetime]:
        """From ``start`` on, in order; days are looked at for some five years."""
        midnight = start.replace(hour=0, minute=0, second=0, microsecond=0)
        for k in range(366 * 5):
            day = midnight + timedelta(days=k)
            if self.times:
                found = [day + timedelta(seconds=s) for s in sorted(set(self.times))]
            elif self.seconds and self.seconds < 86400:
                found = [day + timedelta(seconds=s) for s in range(0, 86400, self.seconds)]
            else:  # every so many days, counted from a fixed day
                period = max(1, (self.seconds or 86400) // 86400)
                found = [day + timedelta(seconds=self.after)] if day.toordinal() % period == 0 else []
            yield from (t for t in found if t >= start and self.allows(t))


@dataclass
class Parsed:
    schedules: list[Schedule]
    error: int = -1  # where the text couldn't be read

    def next_times(self, start: datetime, n: int = 1) -> list[datetime]:
        found = sorted({t for s in self.schedules for t, _ in zip(s.moments(start), range(n), strict=False)})
        return found[:n]


def _seconds(h: str, m: str, s: str | None, half: str | None) -> int | None:
    hour = int(h)
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half.lower() == "pm")
    return None if hour > 23 or int(m) > 59 or int(s or 0) > 59 else hour * 3600 + int(m) * 60 + int(s or 0)


def parse_schedule(text: str) -> Parsed:
    """The schedules of a text; ``error`` is the position of what can't be read, -1 if all can, and an empty text can't."""
    out, now, at = [], Schedule(), 0
    end = len(text.rstrip().rstrip(","))
    if not end:
        return Parsed([], 0)
    while at < end:
        at += len(text[at:]) - len(text[at:].lstrip(" ,\t\n"))
        kind, m = next(((k, m) for k, p in _CLAUSES if (m := p.match(text, at))), (None, None))
        if m is None:
            return Parsed([], at)
        if kind == "also":
            out.append(now)
            now = Schedule()
        elif kind == "every":
            unit = {"sec": "second", "min": "minute"}.get(m[2].lower(), m[2].lower())
            now.seconds = max(1, int(m[1] or 1)) * UNITS[unit]
        elif kind in ("weekday", "weekend"):
            now.days = set(range(5)) if kind == "weekday" else {5, 6}
        elif kind == "on":
            now.days = (now.days or set()) | {next(i for i, d in enumerate(DAYS) if d.startswith(m[1].lower()[:3]))}
        elif kind == "month day":
            now.month_day = {"first": 1, "last": -1}.get(m[1].lower()) or int(re.sub(r"\D", "", m[1]))
            if now.month_day > 31:
                return Parsed([], at)
        else:
            when = _seconds(*m.groups())
            if when is None:
                return Parsed([], at)
            if kind == "at":
                now.times.append(when)
            else:
                setattr(now, kind, when)
        at = m.end()
    return Parsed([*out, now])


def explain(text: str) -> list[str]:
    """What is wrong with a schedule, as lines with a mark below the place; none if it can be read."""
    at = parse_schedule(text).error
    return [] if at < 0 else ["Syntax error in schedule:", f">  {text}", f">  {' ' * at}^"]


def run_on_schedule(text: str, job: Callable[[], object], runs: int, now: Callable[[], datetime] = datetime.now, sleep: Callable[[float], None] = time.sleep) -> list[datetime]:
    """Runs the job at the schedule's next ``runs`` times, one after another; times that pass while it runs are left out.  Returns when it was due."""
    schedule, due = parse_schedule(text), []
    while len(due) < runs and (following := schedule.next_times(now() + timedelta(microseconds=1))):
        due += following
        sleep(max(0.0, (following[0] - now()).total_seconds()))
        job()
    return due


def trigger_period(text: str) -> str | None:
    """The ``processingTime`` of a streaming query that runs every so often; None for other schedules."""
    found = parse_schedule(text)
    one = found.schedules[0] if len(found.schedules) == 1 else None
    return f"{one.seconds} seconds" if one and one.seconds and one == Schedule(seconds=one.seconds) else None
