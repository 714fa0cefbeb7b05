"""The life of a source told by its polls and the clock."""

import random

import pandas as pd

from newsloom.streaming.timers import Life, Patience, SourceLives

P = Patience(error=3, alert=8, client_alert=2, silent_ms=10, expire_ms=35)


def told(polls, clock, steps=()):
    """Polls told as the clock passes `steps`."""
    life, out, done = Life(), [], 0
    polls = sorted(polls)
    for now in [*sorted(steps), clock]:
        while done < len(polls) and polls[done][0] < now:
            at, failed, client = polls[done]
            out += life.poll(at, failed, client, P)
            done += 1
        out += life.until(now - 1, P)
    return out, life


def test_outages():
    polls = [(k, True, False) for k in range(9)] + [(9, False, False), (10, True, True), (11, True, True), (12, True, True)]
    assert told(polls, 13)[0] == [("error", 2, 3), ("alert", 7, 8), ("revived", 9, 9), ("alert", 11, 2), ("error", 12, 3)]


def test_silence_is_told_without_a_poll():
    assert told([(0, True, False)], 10)[0] == []
    assert told([(0, True, False)], 11)[0] == [("silent", 10, 1)]
    out, life = told([(0, True, False)], 1000)
    assert out == [("silent", 10, 1), ("probe", 20, 1), ("probe", 30, 1), ("expired", 35, 1)] and life == Life()
    assert told([(0, True, False), (36, True, False)], 40)[0] == out
    assert told([(0, True, False), (35, True, False)], 40)[0] == out[:3]  # just in time: the failures count on


def test_when_the_clock_is_looked_at_makes_no_difference():
    draw = random.Random(4)
    for _ in range(300):
        polls = [(draw.randint(0, 120), draw.random() < 0.6, draw.random() < 0.5) for _ in range(draw.randint(0, 20))]
        whole = told(polls, 200)
        assert told(polls, 200, [draw.randint(0, 200) for _ in range(6)]) == whole


def test_due_is_when_the_next_thing_happens():
    draw = random.Random(5)
    for _ in range(200):
        _, life = told([(draw.randint(0, 50), True, False) for _ in range(3)], draw.randint(51, 90))
        due = life.due(P)
        if due is not None:
            assert life.until(due - 1, P) == [] and life.until(due, P)[0][1] == due


class Held:
    """State and timers of one key, as Spark would keep them."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getValueState(self, name, schema):
        return Value(self.values, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Value:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values[self.name]

    def update(self, value):
        self.values[self.name] = value

    put = update

    def appendList(self, rows):
        self.values[self.name] = [*self.values.get(self.name, []), *rows]

    def clear(self):
        self.values.pop(self.name, None)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_bucket_tells_what_each_of_its_sources_would():
    """Python is asked once for a bucket and a step of the clock, not once for each source and timer."""
    draw = random.Random(6)
    for _ in range(60):
        polls = {s: [(at, k, draw.random() < 0.6, draw.random() < 0.5) for k, at in enumerate(draw.sample(range(120), draw.randint(1, 20)))] for s in range(draw.randint(1, 12))}
        held, got = Held(), []
        life = SourceLives(P)
        life.init(held)
        rows = [(s, *p) for s, ps in polls.items() for p in ps]
        now = 0
        for step in (*sorted(draw.randint(1, 150) for _ in range(5)), 400):
            new = [r for r in rows if now <= r[1] < step + 10]  # some arrive before the clock gets to them
            rows = [r for r in rows if r not in new]
            draw.shuffle(new)
            if new:
                list(life.handleInputRows((0,), iter([pd.DataFrame(new, columns=["source_id", "at_ms", "seq", "failed", "client"])]), Clock(now)))
            now, asked = step, 0
            while due := [t for t in held.timers if t <= now]:
                for frame in life.handleExpiredTimer((0,), Clock(now), None):
                    got += frame.itertuples(index=False, name=None)
                held.timers.remove(due[0])
                asked += 1
            assert asked <= 1 and len(held.timers) <= 1
        expect = [(s, *x) for s, ps in polls.items() for x in told([(at, f, c) for at, _, f, c in ps], 400)[0]]
        assert sorted(got) == sorted(expect) and not held.values
