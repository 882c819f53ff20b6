"""Pages of keyed state: calls to the store grow with the pages, not with the keys."""

from __future__ import annotations

import random

import pandas as pd

from ravine.operators import state
from ravine.streaming import keyed


class Store:
    """A value state and timers that count their calls."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_a_page_of_jobs():
    """2,000 jobs of a page in two batches."""
    rng, n = random.Random(5), 2000
    rows = pd.DataFrame([(rng.randrange(n), i, i, rng.choice(list(state.ACTIONS))) for i in range(8 * n)], columns=["job_id", "at", "event_id", "action"])
    store, machine = Store(), keyed.Machine()
    machine.init(store)
    got = pd.concat([pd.concat(list(machine.handleInputRows((0,), iter([part]), None))) for part in (rows[: 4 * n], rows[4 * n :])])
    assert store.calls <= 4
    jobs = {}
    for r in got.sort_values("at").itertuples():
        ok, *jobs[r.job_id] = state.advance(*jobs.get(r.job_id, state.BEGIN), r.action)
        assert (ok, *jobs[r.job_id]) == (r.accepted, r.status, r.retries)
    assert len(got) == len(rows)


def test_a_page_forgets_ended_jobs():
    """the page's timer stands at the first job to go; active ones stay."""
    rows = pd.DataFrame({"job_id": [1, 2, 3], "event_id": [1, 2, 3], "status": ["failed", "queued", "failed"], "updated_ms": [0, 0, 60_000], "polled_ms": [0, 0, 60_000]})

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    store, feed = Store(), keyed.Feed()
    feed.init(store)
    assert len(pd.concat(list(feed.handleInputRows((0,), iter([rows]), None)))) == 3
    assert store.timers == [keyed.VISIBLE_MS]
    list(feed.handleExpiredTimer((0,), At(keyed.VISIBLE_MS), At(keyed.VISIBLE_MS)))
    assert set(feed.read()) == {2, 3} and store.timers[-1] == 60_000 + keyed.VISIBLE_MS
    list(feed.handleExpiredTimer((0,), At(store.timers[-1]), At(store.timers[-1])))
    assert set(feed.read()) == {2}
