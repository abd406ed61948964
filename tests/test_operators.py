"""Golden values of operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions import special, text
from thalweg.operators import calendar as cal
from thalweg.operators import climatology, events, inference, joins, stats, supervised, tables, vertical, windows
from thalweg.sources import readers, sinks
from thalweg.streaming import windows as st


def profile(spark, depths, values, name="a"):
    return spark.createDataFrame([(name, float(d), v if v is None else float(v)) for d, v in zip(depths, values, strict=True)], "profile_id string, depth_m double, t double")


def test_heat_content_of_a_constant_profile(spark):
    p = profile(spark, [0, 100, 200, 300], [10] * 4)
    assert math.isclose(vertical.trapezoid(p).first().total, 1025 * 3990 * 10 * 300)
    p = profile(spark, [0.5, 100, 300, 650, 760], [10] * 5)
    assert math.isclose(vertical.layer_content(p, 0, 700).first().content, 1025 * 3990 * 10 * 700)


def test_uncovered_layer(spark):
    p = profile(spark, [0.5, 100, 300, 500], [10] * 4)
    assert vertical.layer_content(p, 0, 700).first().content is None
    with pytest.raises(Exception, match="cannot integrate exactly"):
        vertical.layer_content(p, 0, 700, strict=True).collect()


def test_crossing(spark):
    assert math.isclose(vertical.crossing_depth(profile(spark, [0, 50, 100, 150], [26, 22, 19, 16])).first().depth, 83.33333333333333)
    assert vertical.crossing_depth(profile(spark, [0, 50], [19, 18])).first().depth is None
    assert vertical.crossing_depth(profile(spark, [0, 50, 90], [20, 20, 3])).first().depth == 25.0


def test_mixed_layer_keeps_the_least_difference(spark):
    assert vertical.mixed_layer_depth(profile(spark, [0, 10, 20, 30], [20, 18, 19.4, 15])).first().depth == 20.0


def test_weeks_across_a_year(spark):
    days = [(dt.date(2000, 12, 25) + dt.timedelta(i), 1.0 if i < 7 else 2.0) for i in range(14)]
    got = {r.week_end: r for r in cal.weekly_sum(spark.createDataFrame(days, "d date, v double")).collect()}
    assert [got[d].total for d in sorted(got)] == [7.0, 14.0] and sorted(got)[0] == dt.date(2000, 12, 31)
    part = [(dt.date(2001, 1, 3) + dt.timedelta(i), 1.0) for i in range(12)]
    got = sorted(cal.weekly_sum(spark.createDataFrame(part, "d date, v double")).collect(), key=lambda r: r.week_end)
    assert (got[0].total, got[0].expected_days, got[0].is_partial) == (None, 5, True) and got[1].total == 7.0


def test_monthly_events(spark):
    v = [0.0] * 36
    v[8:13] = [0.6, 0.8, 1.0, 0.88, 0.55]
    v[24:29] = [-0.55, -0.82, -1.1, -0.9, -0.6]
    rows = [(dt.date(2000 + i // 12, i % 12 + 1, 1), x) for i, x in enumerate(v)]
    series = spark.createDataFrame(rows, "month date, oni double")
    got = sorted(events.threshold_events(series).collect(), key=lambda r: r.onset)
    assert [r.event_type for r in got] == ["warm", "cold"] and [abs(r.peak_value) for r in got] == [1.0, 1.1]
    e = events.threshold_events(series)
    wide, narrow = ({r.event_id: r for r in events.peak_band(e, series, f).collect()} for f in (0.8, 0.95))
    key = got[0].event_id
    assert wide[key].peak_band_end - wide[key].peak_band_start > narrow[key].peak_band_end - narrow[key].peak_band_start
    weeks = spark.createDataFrame([(dt.date(2000, 1, 2) + dt.timedelta(7 * i),) for i in range(157)], "week_end date")
    seen = {(r.event_type, r.phase) for r in events.lifecycle(weeks, e, events.peak_band(e, series, 0.8)).collect()}
    assert {(t, p) for t in ("warm", "cold") for p in ("genesis", "growth", "peak", "decay")} <= seen


def test_missing_month_breaks_a_run(spark):
    rows = [(dt.date(2000, m, 1), 1.0) for m in (1, 2, 3, 5, 6, 7)]
    series = spark.createDataFrame(rows, "month date, oni double")
    assert events.threshold_events(series, least=4).count() == 0
    assert events.gap_tolerant_runs(series, "oni", "month", 0.5, 5).first().months == 6


def test_release_dates(spark):
    days = spark.createDataFrame([(dt.date(2001, 2, 1) + dt.timedelta(i),) for i in range(50)], "d date")
    monthly = spark.createDataFrame([(dt.date(2001, 1, 1), 10.0), (dt.date(2001, 2, 1), 20.0)], "month date, v double")
    got = {r.d: r.v for r in joins.asof_join(days, joins.released(monthly, "month", 15), "d", "release", "v").collect()}
    assert (got[dt.date(2001, 2, 14)], got[dt.date(2001, 2, 15)], got[dt.date(2001, 3, 15)]) == (None, 10.0, 20.0)


def test_known_lag(spark):
    rows = [(dt.date(2000, 1, 2) + dt.timedelta(7 * i), math.sin(i * 0.7) + (i % 5)) for i in range(120)]
    x = spark.createDataFrame(rows, "d date, x double")
    y = x.select(F.date_add("d", 14).alias("d"), F.col("x").alias("y"))
    pairs = joins.lag_join(x, y, (0, 7, 14, 21))
    best = stats.best_lag(stats.grouped_correlation(pairs.withColumn("g", F.lit(1)), ["g", "lag"]), ["g"]).first()
    assert best.lag == 14 and math.isclose(best.r, 1.0)
    with pytest.raises(ValueError, match="lag"):
        joins.lag_join(x, y, (-1,))


def test_unpaired_keys_raise(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double"), spark.createDataFrame([(1, 1.0)], "k int, v double")
    with pytest.raises(Exception, match="unpaired"):
        joins.paired(a, b, ["k"], "v").collect()
    with pytest.raises(Exception, match="duplicate"):
        joins.many_to_one(a, b.unionByName(b).withColumnRenamed("v", "w"), ["k"]).collect()


def test_heatwave(spark):
    rows = [(1, dt.date(2000, 1, 1) + dt.timedelta(i), 30.0 if 10 <= i <= 15 else 25.0) for i in range(60)]
    got = events.percentile_runs(spark.createDataFrame(rows, "p int, d date, v double"), ["p"], 0.8, 5).collect()
    assert len(got) == 1 and got[0].days == 6


def test_benjamini_hochberg_and_simes(spark):
    df = spark.createDataFrame([(1, p) for p in (0.01, 0.04, 0.03, 0.5, None)], "g int, p double")
    q = {r.p: r.q for r in stats.benjamini_hochberg(df, ["g"]).collect()}
    assert q[None] is None and math.isclose(q[0.01], 0.04) and math.isclose(q[0.03], 0.16 / 3) and math.isclose(q[0.04], 0.16 / 3) and q[0.5] == 0.5
    assert math.isclose(stats.simes(df, ["g"]).first().simes, 0.04)


def test_special_functions():
    assert np.allclose(special.ndtr([0, 1.96]), [0.5, 0.9750021]) and np.allclose(special.ndtri([0.025, 0.5]), [-1.959964, 0], atol=1e-6)
    assert np.allclose(special.gammainc([1, 2, 5], [1, 2, 10]), [0.6321206, 0.5939942, 0.9707473])
    assert np.allclose(special.betainc([2, 0.5, 5], [3, 0.5, 2], [0.3, 0.5, 0.9]), [0.3483, 0.5, 0.885735])
    assert math.isclose(float(special.t_two_sided(np.array([2.2281388519649385]), 10)[0]), 0.05, rel_tol=1e-6)
    assert math.isclose(float(special.chi2_sf([3.841458820694124], 1)[0]), 0.05, rel_tol=1e-6)


def test_p_value(spark):
    got = spark.createDataFrame([(0.5, 20.0), (None, 5.0)], "r double, n double").select(stats.p_of_r("r", "n").alias("p")).collect()
    assert math.isclose(got[0].p, 0.02476, abs_tol=1e-4) and got[1].p is None


def test_harmonic_residuals_are_orthogonal(spark):
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(i), 5 + 3 * math.sin(2 * math.pi * ((dt.date(2000, 1, 1) + dt.timedelta(i)).timetuple().tm_yday - 1) / 365.2425) + (i % 7)) for i in range(1461)]
    out = climatology.harmonic_anomaly(spark.createDataFrame(rows, "d date, x double"))
    design = climatology.fourier_design("d")
    sums = out.agg(*[F.sum(F.col("anomaly") * c) for c in design]).first()
    assert all(abs(x) < 1e-6 for x in sums)


def test_spi_is_standard(spark):
    rows = [(dt.date(1990, 1, 7) + dt.timedelta(7 * i), float((i * 37) % 101)) for i in range(1500)]
    out = climatology.spi(spark.createDataFrame(rows, "week_end date, v double"), weeks=4).where("spi is not null").agg(F.avg("spi"), F.stddev("spi")).first()
    assert abs(out[0]) < 0.1 and 0.8 < out[1] < 1.2


def test_iso_week_53_and_zero_cells(spark):
    rows = [(p, dt.date(1991, 1, 6) + dt.timedelta(7 * i), 0.0 if p == 1 else float((i * 13) % 29)) for p in (1, 2) for i in range(1600)]
    out = climatology.iso_week_robust(spark.createDataFrame(rows, "pixel_id int, week_end date, v double"), ["pixel_id"], least_years=20)
    got = {r.pixel_id: r for r in out.groupBy("pixel_id").agg(F.count("z").alias("n"), F.max(F.abs("z")).alias("top")).collect()}
    assert got[1].n == 0 and 0 < got[2].top < 20


def test_folds_keep_an_embargo(spark):
    f = supervised.walk_forward_folds(1995, 2001, 3, 1, 1, 28)
    assert [x["fold"] for x in f] == [0, 1, 2]
    days = spark.createDataFrame([(dt.date(1997, 12, 20),), (dt.date(1997, 11, 20),), (dt.date(1998, 1, 1),), (dt.date(1999, 5, 1),)], "d date")
    assert [r.s for r in days.select(supervised.split_of("d", f[0]).alias("s")).collect()] == [None, "train", "validation", "test"]


def test_seams_and_coverage(spark):
    rows = [(dt.date(2000, 1, 2) + dt.timedelta(7 * i), 1 if i < 60 else 2, (i % 3) * 1.0 + (0 if i < 60 else 50)) for i in range(120)]
    got = windows.seams(spark.createDataFrame(rows, "w date, code int, x double"), "code", "x", [], "w").collect()
    assert len(got) == 1 and got[0].is_seam
    gaps = spark.createDataFrame([(1, dt.date(2000, 1, i), None if i in (3, 4, 5, 9) else 1.0) for i in range(1, 11)], "p int, d date, x double")
    r = windows.coverage(gaps, "x", ["p"], "d").first()
    assert (r.longest_gap, r.valid_share) == (3, 0.6)


def test_text(spark):
    row = spark.range(1).select(text.slug(F.lit(" Éa--B c! ")).alias("a"), text.percentile_label(F.lit(97.5)).alias("b"), text.percentile_label(F.lit(90)).alias("c"), text.longitude_label(F.lit(190.0)).alias("d"), text.truth(F.lit(" YES")).alias("e"), text.tolerant_date(F.lit(20240231)).alias("f")).first()
    assert tuple(row) == ("ea_b_c", "p97p5", "p90", "170W", True, None)


def test_weighted_quantile_and_shares(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 3.0, 2.0), (2, 0.0, 1.0)], "g int, v double, w double")
    assert math.isclose({r.g: r.quantile for r in tables.weighted_quantile(df, ["g"], "v", "w", 0.5).collect()}[1], 2 + (0.5 - 0.375) / 0.375)
    assert {r.share for r in tables.share(df, ["g"], "v").where("g = 2").collect()} == {None}


def test_picked_peaks(spark):
    rows = [(1, dt.date(2000, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate([0, 5, 4, 0, 0, 3, 9, 0])]
    got = inference.picked_peaks(spark.createDataFrame(rows, "p int, d date, v double"), ["p"], "d", "v", 1, 2, 3).orderBy("rank").collect()
    assert [r.v for r in got] == [9.0, 5.0]


def test_ledger(spark, tmp_path):
    path = tmp_path / "ledger.jsonl"
    path.write_text('{"id": "a", "n": 1}\nnot json\n{"n": 2}\n\n')
    entries, issues = readers.read_ledger(spark, str(path), spark.createDataFrame([], "id string, n long").schema, ["id"])
    assert [tuple(r) for r in entries.collect()] == [("a", 1)] and sorted(r.reason for r in issues.collect()) == ["malformed", "missing: id"]


def test_checked_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, c string, v double")
    path = f"{tmp_path}/t"
    sinks.write_checked(df, path, ["k"], {"c": ["a", "b"]}, ("v",))
    assert sinks.verify(spark, path)
    df.limit(1).write.mode("append").parquet(path)
    assert not sinks.verify(spark, path)
    with pytest.raises(ValueError, match="contract"):
        sinks.write_checked(df.unionByName(df), f"{tmp_path}/u", ["k"])
    with pytest.raises(Exception, match="two shards"):
        sinks.merged_shards([df, df], ["k"]).collect()


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, c string")
    for suffix in ("parquet", "json", "csv", "orc"):
        df.write.format(suffix).option("header", True).save(f"{tmp_path}/x.{suffix}")
        assert [tuple(r) for r in readers.read_table(spark, f"{tmp_path}/x.{suffix}", "k int, c string").collect()] == [(1, "a")]
    with pytest.raises(ValueError, match="no reader"):
        readers.read_table(spark, "x.nc")
    weekly = spark.createDataFrame([(dt.datetime(2000, 1, 1) + dt.timedelta(7 * i),) for i in range(5)], "ts timestamp")
    with pytest.raises(ValueError, match="coarser"):
        readers.require_not_coarser(weekly, "ts")
    ragged = readers.ragged(spark.createDataFrame([(1, 2), (2, 3)], "cast_id int, size int"), spark.createDataFrame([(i, i * 1.0) for i in range(5)], "position int, v double"))
    assert sorted((r.cast_id, r.level) for r in ragged.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_open_runs_span_batches(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, h), v) for h, v in enumerate([0.0, 2.0, 3.0, 0.0, 5.0, 0.0])]
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], "key string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = st.stream_of(spark, f"{tmp_path}/in")
    got = st.drained(st.open_runs(stream, "key", "ts", "value", 1.0), "append").orderBy("run").collect()
    assert [(r.run, r.n, r.top) for r in got] == [(0, 2, 3.0), (1, 1, 5.0)]
