"""Whole events in a task: rows near each other, and what is shuffled and written for them."""

import numpy as np
import pytest

from hitloom.functions import geometry as G
from hitloom.operators import events as EV
from hitloom.operators import tracking as T
from hitloom.plans.tracking import track_hits


@pytest.mark.parametrize("ellipse", [True, False])
@pytest.mark.parametrize(("dx", "dy"), [(3.0, 2.0), (0.0, 2.0), (0.0, 0.0), (-1.0, 1.0)])
def test_near_as_brute_force(ellipse, dx, dy):
    rng = np.random.default_rng(3)
    event = np.repeat(np.arange(60), rng.integers(1, 90, 60))
    x, y = (rng.integers(0, 80, len(event)) / 2 for _ in "xy")
    x[rng.random(len(x)) < 0.1] = np.nan
    u, v = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    close = EV.inside(u, v, dx, dy, ellipse) & (event[:, None] == event) & ~np.eye(len(x), dtype=bool)
    assert np.array_equal(EV.Neighbours(event).near(x, y, dx, dy, ellipse), close.any(axis=1))


def test_crowded_event_is_not_all_pairs():
    x, y = np.random.default_rng(4).random((2, 300_000))
    assert EV.Neighbours(np.zeros(300_000)).near(x, y, 0.5, 0.5, True).all()


def test_isolation_writes_and_joins_nothing(spark, sf_dir, monkeypatch, capsys):
    monkeypatch.setattr("hitloom.runtime.Scratch.table", lambda *a: pytest.fail("a table was written"))
    T.fit_tracks(track_hits(spark, sf_dir), G.TRACK_PLANES, [0, 1, 2, 3, 4, 5], [1, 2, 3, 4], isolation=(1000.0, 1000.0)).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange") == 1
