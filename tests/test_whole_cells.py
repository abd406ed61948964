"""Queries and keyed operators over every cell, not some of them."""

import datetime
import os

import numpy as np
import pytest

from thalweg.operators import inference, stats
from thalweg.plans import registry
from thalweg.plans.analysis import lagged_pairs
from thalweg.sources.views import cube_daily

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def series(spark):
    """(cell, t, e, x, y) of three cells of unlike lengths."""
    r = np.random.default_rng(1)
    day = lambda i: datetime.date(2000, 1, 2) + datetime.timedelta(7 * i)
    out = [(c, day(i), day(i).year, *map(float, r.normal(size=2))) for c, n in enumerate((90, 70, 83)) for i in range(n)]
    return spark.createDataFrame(out, "cell int, t date, e int, x double, y double").cache(), out


@pytest.mark.parametrize("name", ["circular_shift_null", "kruskal_effect", "block_bootstrap", "event_bootstrap_lags", "circular_event_roll"])
def test_every_cell(spark, name):
    cells = {r.pixel_id for r in lagged_pairs(spark, SF).select("pixel_id").distinct().collect()}
    assert len(cells) > 5
    assert {r.pixel_id for r in registry.QUERIES[name](spark, SF).collect()} == cells


def test_feature_matrix_keeps_every_value(spark):
    cube = {(r.d, r.pixel_id): r.v for r in cube_daily(spark, SF).collect()}
    rows = registry.QUERIES["feature_matrix"](spark, SF).collect()
    got = {(r.d, int(c[5:])): v for r in rows for c, v in r.asDict().items() if c.startswith("cell_") and v is not None}
    assert got == cube and len(rows[0]) == 27


def test_keyed_shifts_and_rolls(series):
    df, rows = series
    shifts = {(r.cell, r.shift): r.r for r in stats.circular_shifts(df, "t", "x", "y", [7, 30], ("cell",)).collect()}
    rolled = {(r.cell, r.t): r.rolled for r in inference.rolled_events(df, "e", "t", "y", 5, ("cell",)).collect()}
    assert len(shifts) == 6 and len(rolled) == len(rows)
    for c in range(3):
        own = [r for r in rows if r[0] == c]
        x, y = np.array([r[3] for r in own]), np.array([r[4] for r in own])
        for s in (7, 30):
            assert abs(shifts[c, s] - np.corrcoef(x, np.roll(y, -s))[0, 1]) < 1e-9
        for e in {r[2] for r in own}:
            event = [r for r in own if r[2] == e]
            assert [rolled[c, r[1]] for r in event] == np.roll([r[4] for r in event], 5).tolist()


def test_keyed_blocks_as_alone(series):
    df, _ = series
    got = {r.cell: r for r in stats.block_bootstrap(df, "t", "x", "y", 10, 50, keys=("cell",)).collect()}
    assert sorted(got) == [0, 1, 2]
    for c in got:
        alone = stats.block_bootstrap(df.where(f"cell = {c}"), "t", "x", "y", 10, 50).first()
        assert got[c].n_draws == 50 and np.allclose(tuple(got[c])[1:], tuple(alone))
