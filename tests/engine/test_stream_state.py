"""State functions of the streams on plain frames: order, terminal events, and no frame joined or sorted for each key."""

import random

import pandas as pd
import pytest

from docloom.streaming import jobs


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


@pytest.fixture
def no_frames(monkeypatch):
    monkeypatch.setattr(pd, "concat", lambda *a, **b: pytest.fail("a frame is built for each key"))


def test_history_over_batches(no_frames):
    rng, state, run, want = random.Random(3), State(), jobs._history(4), []
    for k, names in enumerate((["a", "b"], ["a", "b"], ["a", "error"], ["b"])):
        rows = [(100 * k + i, rng.choice(names)) for i in range(9)]
        for r in rows:
            if not want or want[-1][1] != "error":
                want.append(r)
        rng.shuffle(rows)
        frames = [pd.DataFrame(rows[:5], columns=["seq", "event"]), pd.DataFrame(rows[5:], columns=["seq", "event"])]
        (out,) = run((1,), iter(frames), state)
        assert out["events"][0] == [e for _, e in want[-4:]] and out["last_seq"][0] == want[-1][0] and out["finished"][0] == (want[-1][1] == "error")


def test_snapshots_over_batches(no_frames):
    state, seen = State(), []
    for rows in ([(2, "down"), (1, "up")], [(4, "down"), (3, "down")], [(6, "down"), (5, "up")]):
        (out,) = jobs._snapshot((1,), iter([pd.DataFrame(rows, columns=["id", "sentiment"])]), state)
        seen.append(tuple(int(x) for x in out.iloc[0]))
    assert seen == [(1, 2, 1, 1, 1), (1, 4, 1, 3, 3), (1, 6, 2, 4, 1)]
