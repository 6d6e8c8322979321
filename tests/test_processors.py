"""Keyed processors in any order of arrival, on states held in plain Python."""

import datetime as dt
import random

import pandas as pd
import pytest

from solvenza.streaming import processors as P

DAY = P.MICROS_A_DAY


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Rows:
    def __init__(self):
        self.held = []

    def exists(self):
        return bool(self.held)

    def get(self):
        return iter(list(self.held))

    def put(self, rows):
        self.held = list(rows)

    def appendList(self, rows):
        self.held += rows

    def clear(self):
        self.held = []


class Map:
    def __init__(self):
        self.held = {}

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)


class Handle:
    def __init__(self):
        self.timers = set()
        self.states = {}

    def _state(self, name, made):
        return self.states.setdefault(name, made)

    def getValueState(self, name, schema):
        return self._state(name, Value())

    def getListState(self, name, schema):
        return self._state(name, Rows())

    def getMapState(self, name, key, value):
        return self._state(name, Map())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def feed(processor, batches, columns, handle=None):
    """The newest version of what goes out, by the columns before the version."""
    handle = handle or Handle()
    out = []
    for batch in batches:
        processor.init(handle)
        frames = iter([pd.DataFrame(batch, columns=columns)])
        for told in processor.handleInputRows((7,), frames, None):
            out += told.astype(object).where(told.notna(), None).to_dict("records")
    return out, handle


def cut(rows, rng, sizes=(1, 2, 5, 40)):
    rows, out = list(rows), []
    while rows:
        n = rng.choice(sizes)
        out.append(rows[:n])
        rows = rows[n:]
    return out


FOLLOW = ["at", "id", "value", "payload"]


def newest(told, *keys):
    found = {}
    for r in told:
        k = tuple(r[c] for c in keys)
        if k not in found or r["version"] > found[k]["version"]:
            found[k] = r
    return found


def plain(rows):
    out, before, change = {}, None, (None, None)
    for at, id, value, payload in sorted(rows):
        if before is not None and value != before:
            change = before, value
        out[at, id] = (value, before, *change)
        before = value
    return out


@pytest.mark.parametrize("seed", range(12))
def test_follow_in_any_order(seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 40) * DAY // 2, i, rng.choice("abc"), f"p{i}") for i in range(90)]
    arriving = rows + rng.sample(rows, 10)
    rng.shuffle(arriving)
    told, _ = feed(P.Follow(180), cut(arriving, rng), FOLLOW)
    got = {k: (r["value"], r["before"], r["change_from"], r["change_to"]) for k, r in newest(told, "at", "id").items()}
    assert got == plain(rows)
    assert all(r["payload"] == f"p{r['id']}" for r in told)


@pytest.mark.parametrize("order", ["reverse", "shuffled", "in order"])
def test_follow_beyond_the_retention(order):
    """Rows inside the retention are as over all rows, and the state stays bounded."""
    rng = random.Random(4)
    rows = [(i * DAY * 3, i, rng.choice("aab"), None) for i in range(400)]
    arriving = list(rows)
    if order == "reverse":
        arriving.reverse()
    elif order == "shuffled":
        rng.shuffle(arriving)
    told, handle = feed(P.Follow(180), cut(arriving, rng), FOLLOW)
    cutoff = rows[-1][0] - 180 * DAY
    got = {k: (r["value"], r["before"], r["change_from"], r["change_to"]) for k, r in newest(told, "at", "id").items()}
    expected = plain(rows)
    assert {k: v for k, v in got.items() if k[0] >= cutoff} == {k: v for k, v in expected.items() if k[0] >= cutoff}
    assert len(handle.states["rows"].held) <= 61 + 7 + 2


def test_rows_in_order_do_not_read_the_list():
    handle = Handle()
    processor = P.Follow(None)
    feed(processor, [[(1, 1, "a", None)], [(2, 1, "a", None)]], FOLLOW, handle)
    handle.states["rows"].get = None
    told, _ = feed(processor, [[(3, 1, "b", None)]], FOLLOW, handle)
    assert (told[0]["before"], told[0]["change_to"], told[0]["version"]) == ("a", "b", 2)


def test_a_row_that_is_there_already_tells_nothing():
    told, _ = feed(P.Follow(180), [[(1, 1, "a", "x")], [(1, 1, "a", "x")], [(1, 1, "b", "y")]], FOLLOW)
    assert len(told) == 1


def test_many_rows_are_taken_in_goes(monkeypatch):
    monkeypatch.setattr(P, "TAKEN", 3)
    frames = iter([pd.DataFrame([(i, i, "ab"[i % 2], None)], columns=FOLLOW) for i in range(10)])
    assert [len(g) for g in P._gathered(frames, FOLLOW)] == [3, 3, 3, 1]


WEEKS = ["at", "id", "kind", "value", "payload"]


def warned(rows, growth=0.35):
    """week -> (at, id, payload) of the weeks that warn, over all rows."""
    negatives, articles, moved, before = {}, {}, set(), None
    for at, id, kind, value, payload in sorted(rows):
        week = at // P.WEEK
        if kind == "news":
            articles.setdefault(week, 0)
            if value == "negative":
                articles[week] += 1
                negatives[week] = (at, id, payload)
        else:
            if before is not None and before != value:
                moved.add(week)
            before = value
    return {
        w: negatives[w] for w, n in articles.items()
        if articles.get(w - 1) and (n - articles[w - 1]) / articles[w - 1] >= growth and w not in moved and n
    }


@pytest.mark.parametrize("seed", range(12))
def test_warnings_in_any_order(seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(9 * 7) * DAY + i, i, "news", rng.choice(["negative", "neutral"]), f"h{i}") for i in range(120)]
    rows += [(rng.randrange(9 * 7) * DAY + i, i, "grade", "4" if rng.random() < 0.93 else "7", None) for i in range(200, 240)]
    rng.shuffle(rows)
    told, _ = feed(P.NewsWeeks(0.35, 180), cut(rows, rng), WEEKS)
    got = {w: (r["at"], r["id"], r["payload"]) for (w,), r in newest(told, "week").items() if r["warns"]}
    assert got == warned(rows)


def test_old_weeks_go():
    rows = [[(w * P.WEEK, w, "news", "negative", None)] for w in range(200)]
    _, handle = feed(P.NewsWeeks(0.35, 180), rows, WEEKS)
    assert len(handle.states["weeks"].held) <= 28


def test_latest_news_and_its_timer():
    rng = random.Random(1)
    rows = [(rng.randrange(10**9), i, "neutral") for i in range(60)]
    told, handle = feed(P.LatestNews(20), cut(rows, rng), ["at", "id", "sentiment"])
    last = max(told, key=lambda r: r["version"])
    expected = sorted(rows, key=lambda r: (-r[0], r[1]))[:20]
    assert list(zip(last["at"], last["id"], last["sentiment"])) == expected
    assert handle.timers == {expected[0][0] // 1000 + 1}
    processor = P.LatestNews(20)
    processor.init(handle)
    end = next(iter(processor.handleExpiredTimer((7,), None, None)))
    assert end["at"][0] == [] and end["version"][0] == last["version"] + 1
    assert not handle.states["latest"].exists()


SOURCES = ["source", "at", "payload"]


def test_sources_are_told_when_all_have_spoken():
    def tell(*batches):
        return [(r["ready"], r["payloads"]) for r in feed(P.Sources(("a", "b")), batches, SOURCES)[0]]

    assert tell([("a", 1, "x")]) == []
    assert tell([("a", 1, "x"), ("b", 1, "y")]) == [(True, {"a": "x", "b": "y"})]
    assert tell([("b", 1, "y")], [("a", 2, "x")], [("a", 1, "old")]) == [(True, {"a": "x", "b": "y"})]
    again = tell([("a", 1, "x"), ("b", 1, "y")], [("b", 2, "z")], [("b", 3, "z")])
    assert again == [(True, {"a": "x", "b": "y"}), (True, {"a": "x", "b": "z"})]
    back = tell([("a", 1, "x"), ("b", 1, "y")], [("b", 2, None)], [("b", 3, "w")])
    assert [r for r, _ in back] == [True, False, True]


@pytest.mark.parametrize("seed", range(5))
def test_sources_in_any_order(seed):
    rng = random.Random(seed)
    rows = [(s, at, rng.choice(["x", "y", "z", None])) for s in "ab" for at in range(6)]
    rng.shuffle(rows)
    told, _ = feed(P.Sources(("a", "b")), cut(rows, rng, (1, 2, 3)), SOURCES)
    final = {s: max((r[1:] for r in rows if r[0] == s))[1] for s in "ab"}
    last = max(told, key=lambda r: r["version"], default=None)
    assert (last is not None and last["ready"]) == all(final.values())
    if last and last["ready"]:
        assert last["payloads"] == final


def test_times_are_whole_microseconds():
    assert P.WEEK == dt.timedelta(days=7) // dt.timedelta(microseconds=1)
