"""The field test against a brute-force one, and that the gate uses it."""

import datetime
import os

import numpy as np

from thalweg.functions.special import t_two_sided
from thalweg.operators import inference
from thalweg.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LAGS = (0, 1, 3)


def brute(x, ys, far):
    """Fractions of the observed lags, and of all offsets and lags."""
    n = len(x)
    offsets = range(far, n - far + 1)

    def share(s, lag):
        ps = []
        for y in ys:
            z = np.roll(y, s)
            both = [(x[i - lag], z[i]) for i in range(lag, n) if np.isfinite(x[i - lag]) and np.isfinite(z[i])]
            if len(both) >= 30:
                r = np.corrcoef(np.array(both).T)[0, 1]
                ps.append(t_two_sided(np.array([abs(r) * np.sqrt((len(both) - 2) / (1 - r * r))]), np.array([len(both) - 2.0]))[0])
        return sum(p <= 0.05 for p in ps) / len(ps)

    return {k: share(0, k) for k in LAGS}, [[share(s, k) for k in LAGS] for s in offsets]


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    n, far = 80, max(LAGS) + 10
    x = r.normal(size=n)
    x[[5, 40]] = np.nan
    ys = [np.r_[0, x[:-1]] + r.normal(size=n) if c < 3 else r.normal(size=n) for c in range(8)]
    for y in ys:
        y[r.integers(1, n - 1, 6)] = np.nan
    day = lambda i: datetime.date(2000, 1, 2) + datetime.timedelta(7 * int(i))
    signal = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(x) if v == v], "t date, x double")
    field = spark.createDataFrame([(c, day(i), float(v)) for c, y in enumerate(ys) for i, v in enumerate(y) if v == v], "c int, t date, y double")
    got = {g.lag: g for g in inference.field_significance(signal, field, "c", "t", "x", "y", LAGS, margin=10).collect()}
    seen, null = brute(x, ys, far)
    tops = [max(f) for f in null]
    assert sorted(got) == list(LAGS)
    for j, k in enumerate(LAGS):
        assert got[k].n_shifts == len(null) and abs(got[k].fraction - seen[k]) < 1e-12
        assert abs(got[k].p_lag - (1 + sum(f[j] >= seen[k] for f in null)) / (1 + len(null))) < 1e-12
        assert abs(got[k].p_field - (1 + sum(t >= seen[k] for t in tops)) / (1 + len(null))) < 1e-12


def test_short_axis_has_no_p(spark):
    rows = [(datetime.date(2000, 1, 2) + datetime.timedelta(7 * i), float(i % 7)) for i in range(60)]
    s = spark.createDataFrame(rows, "t date, x double")
    f = s.selectExpr("1 AS c", "t", "x * x AS y")
    assert all(r.p_field is None and r.n_shifts == 0 for r in inference.field_significance(s, f, "c", "t", "x", "y", (0, 1)).collect())


def test_gate_takes_the_field_test(spark):
    p = {r.lag: r.p_field for r in registry.QUERIES["field_significance_max_lag"](spark, SF).collect()}[0]
    rows = registry.QUERIES["confirmatory_gate"](spark, SF).collect()
    assert rows and p is not None and {r.p_field for r in rows} == {p}
    one = spark.createDataFrame([(0.01, 0.2, 1.0, 9)], "q double, p_field double, same double, events int")
    assert one.select(inference.confirmatory_gate(one, "q", "p_field", "same", "events")).first()[0] == "field_not_significant"
