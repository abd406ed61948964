"""Transformers, contracts, conditions, ranks of p-values and classifiers against independent computations."""

import datetime
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import climatology, models, selection, stats, transformers
from thalweg.operators import supervised as sup
from thalweg.operators.classifiers import classify, gaussian_bayes
from thalweg.operators.inference import drawn_units
from thalweg.operators.windows import lagged
from thalweg.plans import registry
from thalweg.plans.series import cube_weekly, rounded
from thalweg.sources.views import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def day(i):
    return datetime.date(2000, 1, 1) + datetime.timedelta(i)


def test_harmonic_fit_is_numpys_and_can_be_undone(spark):
    r = np.random.default_rng(0)
    rows = [(k, day(i), float(5 * k + 0.01 * i + 3 * math.sin(i / 58) + r.normal())) for k in range(2) for i in range(0, 900, 3)]
    rows += [(2, day(0), 1.0), (0, day(950), None)]
    df = spark.createDataFrame(rows, "k int, d date, x double")
    model = transformers.fit_harmonic(df, F.col("d") < F.lit("2001-06-01").cast("date"), ["k"], harmonics=2)
    out = model.inverse(model.transform(df)).collect()
    assert len(out) == len(rows)
    for k in range(2):
        mine = [x for x in rows if x[0] == k]
        doy = np.array([x[1].timetuple().tm_yday - 1 for x in mine]) * 2 * math.pi / 365.2425
        years = np.array([(x[1] - day(0)).days for x in mine]) / 365.2425
        a = np.stack([np.ones(len(mine)), *(f(h * doy) for h in (1, 2) for f in (np.sin, np.cos)), years], axis=1)
        y = np.array([np.nan if x[2] is None else x[2] for x in mine])
        train = np.array([x[1] < datetime.date(2001, 6, 1) for x in mine]) & np.isfinite(y)
        c = np.linalg.lstsq(a[train], y[train], rcond=None)[0]
        sd = np.sqrt(np.mean((y[train] - a[train] @ c) ** 2))
        got = {x.d: x for x in out if x.k == k}
        for x, f, v in zip(mine, a @ c, y, strict=True):
            assert abs(got[x[1]].fitted - f) < 1e-6
            if np.isfinite(v):
                assert abs(got[x[1]].anomaly - (v - f) / sd) < 1e-6 and abs(got[x[1]].restored - v) < 1e-9
    assert [x.fitted for x in out if x.k == 2] == [None]  # too few rows


def test_seasonal_inverse_has_a_floor(spark):
    rows = [(0, day(7 * i), float(i % 9)) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, d date, v double")
    model = transformers.fit_seasonal(df, F.col("d") < F.lit("2002-01-01").cast("date"), ["k"], "d", "v")
    got = model.inverse(model.transform(df)).collect()
    assert all(abs(r.restored - r.v) < 1e-9 for r in got)
    assert {r.restored for r in model.inverse(model.transform(df).withColumn("z", F.lit(-1e6))).collect()} == {0.0}


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "i int, s string, x double")
    assert selection.numeric_contract(df, ["x", "i"]) == ["x", "i"]
    with pytest.raises(ValueError, match="s"):
        selection.numeric_contract(df, ["x", "s"])
    assert selection.without_aliases(["y", "y_lag1", "oni_y", "z"], "y", ("oni",)) == ["z"]
    with pytest.raises(ValueError):
        selection.parse_condition("neutral:peak")
    assert selection.parse_condition("All") == ("*", "*") and selection.parse_condition("warm:peak") == ("warm", "peak")
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(1, 1.0)], "k int, w double")
    with pytest.raises(Exception, match="grids differ"):
        selection.aligned(a, b, ["k"], "v", "w").collect()
    with pytest.raises(Exception, match="twice"):
        selection.concatenated([a, a], ["k"]).collect()
    assert selection.concatenated([a, a.where("k > 5")], ["k"]).count() == 2


def test_points_in_polygons(spark):
    square = [("s", 0.0, 0.0, 4.0, 0.0), ("s", 4.0, 0.0, 4.0, 4.0), ("s", 4.0, 4.0, 0.0, 4.0), ("s", 0.0, 4.0, 0.0, 0.0)]
    points = [(i, i % 7 - 1.5, i // 7 - 1.5) for i in range(49)]
    got = selection.in_polygon(spark.createDataFrame(points, "i int, x double, y double"), spark.createDataFrame(square, "unit string, x1 double, y1 double, x2 double, y2 double"), "x", "y", ["i"]).collect()
    assert {r.i for r in got} == {i for i, x, y in points if 0 < x < 4 and 0 < y < 4}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_false_discovery_ranks(spark, keys):
    r = np.random.default_rng(2)
    p = [(i % 3, i, float(x)) for i, x in enumerate(r.random(400) ** 4)] + [(0, 1000, None), (1, 1001, 0.0), (1, 1002, 1.0), (2, 1003, 0.5), (2, 1004, 0.5)]
    df = spark.createDataFrame(p, "k int, i int, p double")
    got = {x.i: x.q for x in stats.benjamini_hochberg(df, keys).collect()}
    for k in range(3) if keys else [None]:
        mine = sorted((x for x in p if x[2] is not None and (k is None or x[0] == k)), key=lambda x: x[2])
        q, best = {}, 1.0
        for rank in range(len(mine), 0, -1):
            best = min(best, mine[rank - 1][2] * len(mine) / rank)
            q[mine[rank - 1][1]] = best
        assert all(abs(got[i] - v) < 1e-12 for i, v in q.items())
    assert got[1000] is None and len(got) == len(p)


def test_draws_take_as_many_as_there_are(spark):
    df = spark.createDataFrame([(k, u) for k in range(2) for u in range(4 + k)], "k int, u int")
    got = drawn_units(df, ["k"], "u", 300).collect()
    total = {}
    for r in got:
        total[r.k, r.draw] = total.get((r.k, r.draw), 0) + r.times
    assert set(total.values()) == {4, 5} and all(n == 4 + k for (k, _), n in total.items())
    assert len({r.times for r in got}) > 2
    means = [sum(r.times for r in got if r.k == 0 and r.u == u) / 300 for u in range(4)]
    assert all(abs(m - 1) < 0.2 for m in means)


def test_classifiers_tell_classes_apart(spark):
    r = np.random.default_rng(3)
    rows = [(i, i % 2, float(r.normal(3 * (i % 2))), float(r.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, y int, a double, b double")
    train, test = df.where("i < 300"), df.where("i >= 300")
    bayes = gaussian_bayes(train, test, ["i"], "y", ["a", "b"]).collect()
    assert len(bayes) == 100 and np.mean([x.y == x.predicted for x in bayes]) > 0.85
    for model in ("logistic", "forest", "boosted"):
        got = classify(train, test, ["i"], "y", ["a", "b"], model).collect()
        assert len(got) == 100 and np.mean([(x.p > 0.5) == x.y for x in got]) > 0.8


def test_ridge_is_numpys(spark):
    rows = lagged(cube_weekly(spark, SF), "v", (1, 2, 4), ["pixel_id"], "week_end").dropna()
    folds = sup.walk_forward_folds(1995, 2001, 3, 1, 1, 28)
    got = models.walk_forward_ridge(rows, ["v_lag1", "v_lag2", "v_lag4"], "v", "week_end", "pixel_id", folds).toPandas()
    assert len(got)
    for f in folds:
        marked = rows.withColumn("s", sup.split_of("week_end", f)).toPandas()
        train, test = marked[marked.s == "train"], marked[marked.s == "test"]
        x, y = train[["v_lag1", "v_lag2", "v_lag4"]].to_numpy(), train.v.to_numpy()
        mx, my, sx = x.mean(axis=0), y.mean(), x.std(axis=0, ddof=1)
        z = (x - mx) / sx
        w = np.linalg.solve(z.T @ z / len(z) + 0.1 * np.eye(3), z.T @ (y - my) / len(z))
        want = (test[["v_lag1", "v_lag2", "v_lag4"]].to_numpy() - mx) / sx @ w + my
        mine = got[got.fold == f["fold"]].set_index(["pixel_id", "week_end"]).p
        for k, t, v in zip(test.pixel_id, test.week_end, want, strict=True):
            assert abs(mine[k, t] - v) < 0.05 * max(1.0, abs(v))


def test_components_are_numpys(spark):
    df = table(spark, SF, "embeddings")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    x -= x.mean(axis=0)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    got = models.principal_components(df, "vec_id", "embedding", 4).orderBy("vec_id").toPandas()[["pc1", "pc2", "pc3", "pc4"]].to_numpy()
    assert np.abs(np.abs(got) - np.abs(x @ v[:4].T)).max() < 1e-4
    shares, first = models.explained(df, "vec_id", "embedding", 4, 0.05)
    assert np.allclose(shares, np.cumsum(s[:4] ** 2) / (s**2).sum(), atol=1e-6) and first == 1 + int(np.argmax(np.array(shares) >= 0.05))


def test_clusters_are_whole_and_near(spark):
    df = table(spark, SF, "embeddings")
    got = {r.vec_id: r.cluster for r in models.clusters(df, "vec_id", "embedding", 5).collect()}
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    assert set(got) == set(x)
    centre = {c: np.mean([x[i] for i in x if got[i] == c], axis=0) for c in set(got.values())}
    near = [min(centre, key=lambda c, i=i: float(((x[i] - centre[c]) ** 2).sum())) == got[i] for i in x]
    assert np.mean(near) > 0.97


def test_spi_is_the_gammas_quantile(spark):
    rows = cube_weekly(spark, SF)
    got = climatology.spi(rows, ["pixel_id"]).where("accumulated is not null").toPandas()
    mine = got[got.pixel_id == got.pixel_id.min()].copy()
    mine["week"] = [d.isocalendar()[1] for d in mine.week_end]
    seen = 0
    for _, g in mine.groupby("week"):
        wet = g.accumulated[g.accumulated > 0].to_numpy(float)
        if len(wet) < 3 or wet.var(ddof=1) == 0:
            continue
        shape, scale = wet.mean() ** 2 / wet.var(ddof=1), wet.var(ddof=1) / wet.mean()
        for a, z in zip(g.accumulated, g.spi, strict=True):
            if a > 0 and z is not None and abs(z) < 4:
                t = np.linspace(0, a / scale, 200_001)[1:]
                lower = np.log(t) * (shape - 1) - t - math.lgamma(shape)
                p = float(np.exp(lower).sum() * (t[1] - t[0])) if shape > 1 else None
                if p is not None:
                    assert abs(0.5 * math.erfc(-z / math.sqrt(2)) - p) < 5e-3
                    seen += 1
    assert seen > 10


def test_p_of_a_correlation(spark):
    rows = [(r, n) for r in (0.0, 0.1, -0.4, 0.9) for n in (5.0, 30.0, 200.5)]
    got = spark.createDataFrame(rows, "r double, n double").withColumn("p", stats.p_of_r("r", "n")).collect()
    for x in got:
        t, nu = abs(x.r) * math.sqrt((x.n - 2) / (1 - x.r**2)), x.n - 2
        u = np.linspace(0, t, 400_001)
        pdf = np.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi) * (1 + u**2 / nu) ** (-(nu + 1) / 2)
        inside = float(((pdf[1:] + pdf[:-1]) / 2 * np.diff(u)).sum())
        assert abs(x.p - (1 - 2 * inside)) < 1e-6


def test_gate_verdicts(spark):
    rows = registry.QUERIES["confirmatory_gate"](spark, SF).collect()
    for r in rows:
        want = "not_significant" if r.q is None or r.q > 0.05 else "field_not_significant" if r.p_field is None or r.p_field > 0.05 else "unstable" if r.events < 5 or r.same < 0.8 else "confirmed"
        assert r.verdict == want
    assert rounded(spark.range(1)).count() == 1


def test_stability_is_numpys(spark):
    from thalweg.plans.wider import week_vectors

    rows = week_vectors(spark, SF).orderBy("week_end").collect()
    x, t = np.array([r.v for r in rows]), [str(r.week_end) for r in rows]

    def directions(end):
        part = x[[i for i, d in enumerate(t) if d <= end]]
        return np.linalg.svd(part - part.mean(axis=0), full_matrices=False)[2][:2]

    last = directions("2000-12-31")
    got = registry.QUERIES["pca_stability"](spark, SF).collect()
    assert len(got) == 10
    for r in got:
        assert abs(r.similarity - abs(directions(r.end)[r.component - 1] @ last[r.component - 1])) < 2e-3


def test_linkage_against_plain_joining():
    r = np.random.default_rng(5)
    for _ in range(20):
        names = [f"v{i}" for i in range(8)]
        d = {(a, b): float(r.random()) for i, a in enumerate(names) for b in names[i + 1 :]}
        got = stats.average_linkage(d, names, 0.45)
        full = np.zeros((8, 8))
        for (a, b), v in d.items():
            full[int(a[1]), int(b[1])] = full[int(b[1]), int(a[1])] = v
        groups = [{i} for i in range(8)]
        while len(groups) > 1:
            best = min(((np.mean([full[i, j] for i in a for j in b]), k, l) for k, a in enumerate(groups) for l, b in enumerate(groups) if k < l), key=lambda q: q[0])
            if best[0] >= 0.45:
                break
            groups[best[1]] |= groups[best[2]]
            del groups[best[2]]
        assert {n: {m for m in names if got[m] == got[n]} for n in names} == {f"v{i}": {f"v{j}" for j in g} for g in groups for i in g}


def test_rank_distances(spark):
    r = np.random.default_rng(6)
    x = r.integers(0, 9, size=(300, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    rank = lambda v: np.array([(v < q).sum() + ((v == q).sum() + 1) / 2 for q in v])
    got = stats.rank_distances(df, ["a", "b", "c"], "id")
    for (p, q), d in got.items():
        want = np.corrcoef(rank(x[:, "abc".index(p)]), rank(x[:, "abc".index(q)]))[0, 1]
        assert abs(d - (1 - abs(want))) < 1e-9
