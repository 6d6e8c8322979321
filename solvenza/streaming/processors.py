"""Keyed state: what a stream remembers of a company between micro-batches.

Each class is a processor for ``transformWithStateInPandas``, keyed by company. State lies
in Spark's state store and is committed with the micro-batch, so a batch that runs again
starts from the same state. Rows go out with a ``version`` that grows per company: of rows
about the same thing the one of the greatest version stands. No result depends on the
order in which rows arrive or on how they are cut into files and batches.

Times are whole microseconds (``at``), and an ``id`` tells rows of one time apart.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS_A_DAY = 86_400_000_000
WEEK = 7 * MICROS_A_DAY
# Rows of a company that are taken in at a time; more come in several goes.
TAKEN = 500_000

Frames = Iterator[pd.DataFrame]


def _gathered(frames: Frames, columns: list[str]) -> Iterator[list[tuple]]:
    """The rows as tuples, at most about ``TAKEN`` at a time."""
    held: list[tuple] = []
    for frame in frames:
        # Python values: missing ones are None, whole numbers stay whole.
        held += zip(*[[None if pd.isna(v) else v for v in frame[c].tolist()] for c in columns])
        if len(held) >= TAKEN:
            yield held
            held = []
    if held:
        yield held


class Follow(StatefulProcessor):
    """Compares each value of a company with the one before it.

    Rows have ``at, id, value, payload``; ``before`` is the value before, ``change_from``
    and ``change_to`` the latest change up to the row. Rows that are newer than all before
    need the last one only, and are appended. One that comes late is put in its place in
    the list, and the rows from there on go out again. A row that is there already counts
    once. A company keeps the rows of ``days`` before its own newest one, and of the older
    ones the last and the last that differs from it: they hand on all that the kept rows
    say of the time before.
    """

    ROW = "at bigint, id bigint, value string, payload string, before string, change_from string, change_to string"
    OUT = f"company bigint, {ROW}, version bigint"
    _LAST = "at bigint, id bigint, value string, change_from string, change_to string, oldest bigint, version bigint"
    _NAMES = [c.split()[0] for c in OUT.split(", ")]

    def __init__(self, days: int | None):
        self._keep = None if days is None else days * MICROS_A_DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", self._LAST)
        self._rows = handle.getListState("rows", self.ROW)

    def handleInputRows(self, key: Any, rows: Frames, timerValues: Any) -> Frames:
        for taken in _gathered(rows, ["at", "id", "value", "payload"]):
            new = sorted({r[:2]: r for r in taken}.values(), key=lambda r: r[:2])
            told, version = self._take(new)
            if told:
                yield pd.DataFrame([(key[0], *r, version) for r in told], columns=self._NAMES)

    def _take(self, new: list[tuple]) -> tuple[list[tuple], int]:
        last = tuple(self._last.get()) if self._last.exists() else None
        oldest, version = (last[5], last[6] + 1) if last else (new[0][0], 0)
        if last is None or new[0][:2] > last[:2]:
            told = _compared(new, last[2:5] if last else None)
            self._rows.appendList(told)
        else:
            held = [tuple(r) for r in self._rows.get()]
            places = [r[:2] for r in held]
            known = set(places)
            fresh = [r for r in new if r[:2] not in known]
            if not fresh:
                return [], version
            cut = bisect_left(places, fresh[0][:2])
            again = sorted([*(r[:4] for r in held[cut:]), *fresh], key=lambda r: r[:2])
            told = _compared(again, (held[cut - 1][2], *held[cut - 1][5:]) if cut else None)
            self._rows.put(held[:cut] + told)
            oldest = min(oldest, fresh[0][0])
        end = told[-1]
        # A tenth more than is kept, so that few batches rewrite the list.
        if self._keep is not None and oldest < end[0] - self._keep * 11 // 10:
            kept = self._pruned([tuple(r) for r in self._rows.get()], end[0] - self._keep)
            self._rows.put(kept)
            oldest = next((r[0] for r in kept if r[0] >= end[0] - self._keep), end[0])
        self._last.update((end[0], end[1], end[2], end[5], end[6], oldest, version))
        return told, version

    @staticmethod
    def _pruned(rows: list[tuple], cutoff: int) -> list[tuple]:
        first = bisect_left([r[0] for r in rows], cutoff)
        old = rows[:first]
        differing = next((r for r in reversed(old) if r[2] != old[-1][2]), None)
        return [r for r in (differing, *old[-1:]) if r is not None] + rows[first:]

    def close(self) -> None:
        pass


def _compared(rows: list[tuple], before: tuple | None) -> list[tuple]:
    """``rows`` in order, each with the value before it and the latest change; ``before``
    is (value, change_from, change_to) of the row ahead of them."""
    value, change = (before[0], before[1:]) if before else (None, (None, None))
    first, out = before is None, []
    for row in rows:
        if not first and row[2] != value:
            change = value, row[2]
        out.append((*row, None if first else value, *change))
        value, first = row[2], False
    return out


class NewsWeeks(StatefulProcessor):
    """Weeks in which negative news of a company rose and its grade did not move.

    Rows have ``at, id, kind, value``: articles (``news``) with their sentiment, and grade
    observations (``grade``) with their place on the scale; ``payload`` is the headline.
    A week is a few counts and extremes that rows are added to in any order. A row tells
    of a week whether it warns, and with which article; a later version may take that
    back. Weeks older than ``days`` before the newest go, but for the last two.
    """

    OUT = "company bigint, week bigint, warns boolean, at bigint, id bigint, payload string, version bigint"
    _NAMES = [c.split()[0] for c in OUT.split(", ")]
    # told: what was last said of the week.
    _WEEK = (
        "articles bigint, negative bigint, at bigint, id bigint, payload string, best bigint, worst bigint, "
        "last_at bigint, last_id bigint, last bigint, told string"
    )

    def __init__(self, growth: float, days: int):
        self._growth, self._keep = growth, days * MICROS_A_DAY // WEEK + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._weeks = handle.getMapState("weeks", "week bigint", self._WEEK)
        self._version = handle.getValueState("version", "n bigint")

    def handleInputRows(self, key: Any, rows: Frames, timerValues: Any) -> Frames:
        version = self._version.get()[0] + 1 if self._version.exists() else 0
        self._version.update((version,))
        weeks = {k[0]: list(v) for k, v in self._weeks.iterator()}
        touched: set[int] = set()
        for taken in _gathered(rows, ["at", "id", "kind", "value", "payload"]):
            for row in taken:
                touched.add(row[0] // WEEK)
                self._add(weeks.setdefault(row[0] // WEEK, [0, 0, *[None] * 9]), *row)
        told = []
        for week in sorted(w for w in weeks if w >= min(touched)):
            warns, found = self._warns(weeks, week), weeks[week]
            now = f"{found[2]}:{found[3]}" if warns else ""
            if now != (found[10] or ""):
                found[10] = now
                touched.add(week)
                told.append((key[0], week, warns, *(found[2:5] if warns else (None, None, None)), version))
        oldest = sorted(weeks)[-2:][0]
        for week in weeks:
            if week < min(oldest, max(weeks) - self._keep):
                self._weeks.removeKey((week,))
            elif week in touched:
                self._weeks.updateValue((week,), tuple(weeks[week]))
        if told:
            yield pd.DataFrame(told, columns=self._NAMES)

    @staticmethod
    def _add(week: list, at: int, id: int, kind: str, value: str, payload: str | None) -> None:
        if kind == "news":
            week[0] += 1
            if value == "negative":
                week[1] += 1
                if week[2] is None or (at, id) > (week[2], week[3]):
                    week[2:5] = at, id, payload
        else:
            score = int(value)
            week[5] = score if week[5] is None else min(score, week[5])
            week[6] = score if week[6] is None else max(score, week[6])
            if week[7] is None or (at, id) > (week[7], week[8]):
                week[7:10] = at, id, score

    def _warns(self, weeks: dict[int, list], week: int) -> bool:
        found, before = weeks[week], weeks.get(week - 1)
        if found[2] is None or before is None or not before[1]:
            return False
        if (found[1] - before[1]) / before[1] < self._growth:
            return False
        if found[5] is None:
            return True
        observed = [w for w in weeks if w < week and weeks[w][9] is not None]
        return found[5] == found[6] and (not observed or weeks[max(observed)][9] == found[5])

    def close(self) -> None:
        pass


class LatestNews(StatefulProcessor):
    """The latest ``limit`` articles of a company, as parallel lists, newest first.

    With event time: an article that is older than the watermark, ``days`` behind the
    newest article of all companies, is in no block any more. When a company's newest one
    falls behind it, a timer ends the company's state and tells an empty block.
    """

    OUT = "company bigint, at array<bigint>, id array<bigint>, sentiment array<string>, version bigint"
    _NAMES = [c.split()[0] for c in OUT.split(", ")]

    def __init__(self, limit: int):
        self._limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._latest = handle.getListState("latest", "at bigint, id bigint, sentiment string")
        self._version = handle.getValueState("version", "n bigint")

    def handleInputRows(self, key: Any, rows: Frames, timerValues: Any) -> Frames:
        held = [tuple(r) for r in self._latest.get()] if self._latest.exists() else []
        latest = held
        for taken in _gathered(rows, ["at", "id", "sentiment"]):
            latest = sorted({*latest, *taken}, key=lambda r: (-r[0], r[1]))[: self._limit]
        if latest != held:
            self._latest.put(latest)
            if not held or latest[0][0] != held[0][0]:
                if held:
                    self._handle.deleteTimer(_after(held[0][0]))
                self._handle.registerTimer(_after(latest[0][0]))
            yield self._told(key, latest)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Frames:
        self._latest.clear()
        yield self._told(key, [])

    def _told(self, key: Any, latest: list[tuple]) -> pd.DataFrame:
        # The version stays when the articles go: a company may come back.
        version = self._version.get()[0] + 1 if self._version.exists() else 0
        self._version.update((version,))
        lists = [list(c) for c in zip(*latest)] or [[], [], []]
        return pd.DataFrame([(key[0], *lists, version)], columns=self._NAMES)

    def close(self) -> None:
        pass


def _after(at: int) -> int:
    """Milliseconds of event time at which the article no longer counts."""
    return at // 1000 + 1


class Sources(StatefulProcessor):
    """What each of several sources last said of a company, told when all have spoken.

    Rows have ``source, at, payload``; of a source the row of the greatest ``at`` stands,
    of equal ones the greatest payload. A row goes out when the last source arrives, and
    whenever one of them says something else after that. A NULL payload takes back what a
    source said: the company is told with ``ready`` false then.
    """

    OUT = "company bigint, payloads map<string,string>, ready boolean, version bigint"
    _NAMES = [c.split()[0] for c in OUT.split(", ")]

    def __init__(self, sources: tuple[str, ...]):
        self._sources = sources

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._said = handle.getMapState("said", "source string", "at bigint, payload string")
        self._told = handle.getValueState("told", "ready boolean, version bigint")

    def handleInputRows(self, key: Any, rows: Frames, timerValues: Any) -> Frames:
        said = {k[0]: tuple(v) for k, v in self._said.iterator()}
        before = dict(said)
        for taken in _gathered(rows, ["source", "at", "payload"]):
            for source, at, payload in taken:
                if source not in said or (at, payload or "") > (said[source][0], said[source][1] or ""):
                    said[source] = at, payload
        for source in said:
            if said[source] != before.get(source):
                self._said.updateValue((source,), said[source])
        payloads = {s: said[s][1] for s in self._sources if s in said and said[s][1] is not None}
        ready = len(payloads) == len(self._sources)
        was, version = tuple(self._told.get()) if self._told.exists() else (False, -1)
        same = all(said[s][1] == before.get(s, (None, None))[1] for s in said)
        if (ready and not (was and same)) or (was and not ready):
            self._told.update((ready, version + 1))
            yield pd.DataFrame([(key[0], payloads, ready, version + 1)], columns=self._NAMES)

    def close(self) -> None:
        pass
