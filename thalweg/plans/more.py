"""Registered queries: projections, fields, further inference, audits, readers and sinks, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import calendar as cal
from ..operators import events as ev
from ..operators import fields, grid, inference, joins, stats
from ..operators.climatology import fourier_design
from ..sources import readers, sinks
from ..sources.views import CUBE, PROFILES, SIGNAL, cube_daily, profiles, signal_daily, table
from ..streaming import windows as st
from .analysis import LAGGED, LAGS, lagged_pairs
from .series import BANDS, CUBE_WEEKLY, ONI, PHASES, cube_weekly, events, oni, phase_table, rounded, weekly_signal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- projections and joins


@query(f"WITH {CUBE} SELECT d, pixel_id, v FROM cube WHERE lat BETWEEN -5 AND 5 AND lon BETWEEN 100 AND 250")
def latlon_box(spark, sf_dir):
    return grid.box(cube_daily(spark, sf_dir), 5, -5, 100, 250).select("d", "pixel_id", "v")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer")
def sentinel_to_null(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE isfinite(l_quantity) AND l_linenumber * 10 BETWEEN 0 AND 50 AND l_returnflag IN ('A', 'N') AND l_discount BETWEEN 0.02 AND 0.08")
def qc_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    ok = ~F.isnan("l_quantity") & (F.abs("l_quantity") < float("inf")) & (F.col("l_linenumber") * 10).between(0, 50) & F.col("l_returnflag").isin("A", "N") & F.col("l_discount").between(0.02, 0.08)
    return rows.where(ok).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"WITH {SIGNAL}, m AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month, CASE WHEN count(x) >= day(last_day(min(d))) THEN 'Yes' ELSE 'no' END AS flag FROM signal GROUP BY 1) SELECT month FROM m WHERE lower(flag) IN ('true', '1', 'yes', 'y')")
def complete_months(spark, sf_dir):
    rows = cal.monthly_mean(signal_daily(spark, sf_dir)).withColumn("flag", F.when(F.col("is_complete"), "Yes").otherwise("no"))
    return rows.where(text.truth(F.col("flag"))).select("month")


@query(f"""WITH {PHASES} SELECT a.week_end, lag::INT AS lag, b.event_type AS source_type, b.phase AS source_phase FROM (SELECT week_end FROM phases) a, (VALUES (0), (4), (13)) t(lag) JOIN phases b ON b.week_end = a.week_end - (lag * 7)::INT""")
def source_time_conditions(spark, sf_dir):
    rows = phase_table(spark, sf_dir)
    at = rows.select("week_end").withColumn("lag", F.explode(F.array(F.lit(0), F.lit(4), F.lit(13)))).withColumn("source", F.date_sub("week_end", F.col("lag") * 7))
    return at.join(rows.select(F.col("week_end").alias("source"), F.col("event_type").alias("source_type"), F.col("phase").alias("source_phase")), "source").drop("source")


@query(f"WITH {PHASES} SELECT week_end, (event_type = 'neutral') OR (event_id IS NOT NULL) AS is_valid FROM phases")
def valid_target_mask(spark, sf_dir):
    return phase_table(spark, sf_dir).select("week_end", ((F.col("event_type") == "neutral") | F.col("event_id").isNotNull()).alias("is_valid"))


@query(f"""WITH {PROFILES}, k AS (SELECT profile_id, level, depth_m, t, row_number() OVER (PARTITION BY profile_id, level ORDER BY abs(depth_m - level), depth_m) AS k FROM profiles, (VALUES (12.0::DOUBLE), (25.0::DOUBLE), (60.0::DOUBLE)) q(level))
SELECT profile_id, level, depth_m AS depth, round(t, 6) AS t FROM k WHERE k = 1""")
def channel_levels(spark, sf_dir):
    return rounded(fields.nearest_level(profiles(spark, sf_dir), [12.0, 25.0, 60.0]))


@query(f"""WITH {SIGNAL}, l AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1), m AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month_start, avg(x) AS m FROM signal WHERE year(d) < 2000 GROUP BY 1)
SELECT s.d, round(s.x, 4) AS x, l.q, round(m.m, 4) AS m FROM signal s JOIN l USING (d) LEFT JOIN m ON m.month_start = date_trunc('month', s.d)""")
def multi_source_join(spark, sf_dir):
    s = signal_daily(spark, sf_dir)
    l = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q"))
    m = s.where(F.year("d") < 2000).groupBy(F.trunc("d", "month").alias("month_start")).agg(F.avg("x").alias("m"))
    return rounded(joins.many_to_one(s.join(l, "d").withColumn("month_start", F.trunc("d", "month")), m, ["month_start"]).drop("month_start"), 4)


@query("""WITH c AS (SELECT n_nationkey AS pixel_id, n_regionkey * 5.0::DOUBLE - 10.0 AS lat, n_nationkey * 14.4::DOUBLE AS lon FROM nation), u(unit, south, north, west, east) AS (VALUES ('a', -12.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE), ('b', -1.0, 12.0, 90.0, 360.0)),
p AS (SELECT c.*, u.*, greatest(lat - 2.5, south) AS lo, least(lat + 2.5, north) AS hi FROM c JOIN u ON lat + 2.5 > south AND lat - 2.5 < north AND lon + 2.5 > west AND lon - 2.5 < east)
SELECT pixel_id, unit, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (sin(radians(hi)) - sin(radians(lo))) * (least(lon + 2.5, east) - greatest(lon - 2.5, west)) / ((sin(radians(lat + 2.5)) - sin(radians(lat - 2.5))) * 5.0))), 6) AS fraction FROM p""")
def rectangle_membership(spark, sf_dir):
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pixel_id"), (F.col("n_regionkey") * 5.0 - 10.0).alias("lat"), (F.col("n_nationkey") * 14.4).alias("lon"))
    units = spark.createDataFrame([("a", -12.0, 1.0, 0.0, 100.0), ("b", -1.0, 12.0, 90.0, 360.0)], "unit string, south double, north double, west double, east double")
    return rounded(fields.rectangle_membership(cells, units, 5.0))


@query(f"WITH {SIGNAL}, l AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) SELECT d FROM signal INTERSECT SELECT d FROM l")
def common_dates(spark, sf_dir):
    return signal_daily(spark, sf_dir).select("d").intersect(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")))


# ---- fields


@query(f"""WITH {CUBE}, l AS (SELECT d, lon, avg(v) AS v FROM cube WHERE lat BETWEEN -5 AND 5 GROUP BY ALL) SELECT d, round(lon, 4) AS lon, round(v - avg(v) OVER (PARTITION BY lon), 6) AS v FROM l""")
def hovmoller(spark, sf_dir):
    return rounded(fields.lon_time(cube_daily(spark, sf_dir), (-5.0, 5.0), "d")).withColumn("lon", F.round("lon", 4))


@query(f"""WITH {CUBE}, l AS (SELECT d, lon, avg(v) AS v FROM cube WHERE lat BETWEEN -5 AND 5 GROUP BY ALL), a AS (SELECT d, lon, v - avg(v) OVER (PARTITION BY lon) AS v FROM l), z AS (SELECT *, v - avg(v) OVER (PARTITION BY d) AS a FROM a)
SELECT d, round(lon, 4) AS lon, round(avg(a) OVER (PARTITION BY d ORDER BY lon RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING), 6) AS passed FROM z""")
def zonal_band_pass(spark, sf_dir):
    rows = fields.band_pass(fields.lon_time(cube_daily(spark, sf_dir), (-5.0, 5.0), "d"), "d", 20.0)
    return rounded(rows.select("d", "lon", "passed")).withColumn("lon", F.round("lon", 4))


@query()
def phase_speed(spark, sf_dir):
    weekly = cube_daily(spark, sf_dir).groupBy(cal.week_end("d").alias("week_end"), "lat", F.round("lon", 4).alias("lon")).agg(F.sum("v").alias("v"))
    rows = fields.lon_time(weekly, (-10.0, 10.0), "week_end")
    first = 120.0
    return rounded(fields.phase_speed(fields.lag_by_longitude(rows, first, tuple(range(11)), "week_end"), first))


@query(f"""WITH {CUBE} SELECT region, arg_min(d, (-v, d, lon)) AS d, round(arg_min(lon, (-v, d, lon)), 4) AS lon, max(v) AS v FROM cube GROUP BY region""")
def arg_max_cell(spark, sf_dir):
    return rounded(fields.arg_max_cell(cube_daily(spark, sf_dir), "d", keys=("region",)), 4)


@query(f"""WITH {CUBE}, g AS (SELECT d, pixel_id // 5 AS r, pixel_id % 5 AS c, v FROM cube), q AS (SELECT d, y, x, v, (1 - abs(r - y)) * (1 - abs(c - x)) AS w FROM g, (VALUES (0.5::DOUBLE, 0.5::DOUBLE), (1.25, 2.75), (3.0, 4.0)) t(y, x) WHERE 1 - abs(r - y) > 0 AND 1 - abs(c - x) > 0)
SELECT d, y, x, round(CASE WHEN abs(sum(w) - 1) < 1e-9 THEN sum(v * w) END, 6) AS v FROM q GROUP BY ALL""")
def regrid_bilinear(spark, sf_dir):
    rows = cube_daily(spark, sf_dir).select("d", F.floor(F.col("pixel_id") / 5).alias("row"), (F.col("pixel_id") % 5).alias("col"), "v")
    return rounded(fields.bilinear(rows, [(0.5, 0.5), (1.25, 2.75), (3.0, 4.0)], ("d",)))


@query(f"""WITH {CUBE_WEEKLY}, ph AS (SELECT * FROM (WITH {PHASES} SELECT week_end, phase, event_id FROM phases)) SELECT pixel_id, phase, round(avg(v), 6) AS mean, count(DISTINCT week_end) AS n_weeks, count(DISTINCT event_id) AS n_events FROM cw JOIN ph USING (week_end) GROUP BY 1, 2""")
def composite_by_phase(spark, sf_dir):
    rows = cube_weekly(spark, sf_dir).join(phase_table(spark, sf_dir), "week_end")
    return rounded(rows.groupBy("pixel_id", "phase").agg(F.avg("v").alias("mean"), F.countDistinct("week_end").alias("n_weeks"), F.countDistinct("event_id").alias("n_events")))


@query(f"WITH {PROFILES}, r AS (SELECT profile_id, avg(t - 25) AS e FROM profiles GROUP BY 1) SELECT count(*) AS n, round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM r")
def profile_residuals(spark, sf_dir):
    each = profiles(spark, sf_dir).groupBy("profile_id").agg(F.avg(F.col("t") - 25).alias("e"))
    return rounded(each.agg(F.count("*").alias("n"), F.avg("e").alias("bias"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse")))


# ---- events


@query(f"""WITH {ONI}, e AS (SELECT * FROM (WITH {BANDS} SELECT event_id, onset FROM events_t)), w AS (SELECT e.event_id, o.month, o.oni FROM e JOIN oni o ON o.month < e.onset AND o.month >= e.onset - INTERVAL 6 MONTH WHERE o.oni IS NOT NULL)
SELECT event_id, arg_min(month, (abs(oni), month)) AS genesis FROM w GROUP BY 1""")
def genesis_minimum(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "onset")
    rows = ev.within_years(oni(spark, sf_dir).where("oni is not null"), "month", e, F.add_months("onset", -6), F.col("onset"))
    rows = rows.where((F.col("month") < F.col("onset")) & (F.col("month") >= F.add_months("onset", -6)))
    return rows.groupBy("event_id").agg(F.min_by("month", F.struct(F.abs("oni"), F.col("month"))).alias("genesis"))


def _bounded(weeks: int, fraction: float) -> str:
    phases = PHASES.replace("j.onset - 182", f"j.onset - {weeks * 7}").replace("abs(e.peak_value) * 0.8", f"abs(e.peak_value) * {fraction}")
    return f"SELECT {weeks} AS genesis_weeks, {fraction}::DOUBLE AS fraction, phase, count(*) AS n FROM (WITH {phases} SELECT phase FROM phases) GROUP BY phase"


@query(" UNION ALL ".join(_bounded(w, f) for w in (13, 26, 39) for f in (0.8, 0.9, 0.95)))
def phase_boundary_sensitivity(spark, sf_dir):
    """Weeks in each phase for each pair of genesis window and peak fraction."""
    weeks = weekly_signal(spark, sf_dir).select("week_end")
    e, series, out = events(spark, sf_dir), oni(spark, sf_dir), None
    for weeks_before in (13, 26, 39):
        for fraction in (0.8, 0.9, 0.95):
            part = ev.lifecycle(weeks, e, ev.peak_band(e, series, fraction), genesis_weeks=weeks_before).groupBy("phase").count()
            part = part.select(F.lit(weeks_before).alias("genesis_weeks"), F.lit(fraction).alias("fraction"), "phase", F.col("count").alias("n"))
            out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {PHASES} SELECT event_type, count(DISTINCT event_id) AS events, count(DISTINCT year(week_end) * 4 + quarter(week_end)) AS quarters FROM phases GROUP BY 1")
def independent_counts(spark, sf_dir):
    return phase_table(spark, sf_dir).groupBy("event_type").agg(F.countDistinct("event_id").alias("events"), F.countDistinct(F.year("week_end") * 4 + F.quarter("week_end")).alias("quarters"))


@query(f"""WITH {CUBE}, r AS (SELECT pixel_id, d, avg(v) OVER (PARTITION BY pixel_id ORDER BY d ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS v FROM cube), c AS (SELECT * FROM r WHERE v >= 0.02),
p1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY v DESC, d) = 1), p2 AS (SELECT c.* FROM c JOIN p1 USING (pixel_id) WHERE abs(c.d - p1.d) > 75 QUALIFY row_number() OVER (PARTITION BY c.pixel_id ORDER BY c.v DESC, c.d) = 1),
p3 AS (SELECT c.* FROM c JOIN p1 USING (pixel_id) JOIN p2 USING (pixel_id) WHERE abs(c.d - p1.d) > 75 AND abs(c.d - p2.d) > 75 QUALIFY row_number() OVER (PARTITION BY c.pixel_id ORDER BY c.v DESC, c.d) = 1)
SELECT pixel_id, 1 AS rank, d, round(v, 6) AS v FROM p1 UNION ALL SELECT pixel_id, 2, d, round(v, 6) FROM p2 UNION ALL SELECT pixel_id, 3, d, round(v, 6) FROM p3""")
def picked_peaks(spark, sf_dir):
    w = Window.partitionBy("pixel_id").orderBy("d").rowsBetween(-14, 0)
    rows = cube_daily(spark, sf_dir).select("pixel_id", "d", F.avg("v").over(w).alias("v"))
    return rounded(inference.picked_peaks(rows, ["pixel_id"], "d", "v", 0.02, 75, 3))


# ---- inference


@query(f"""WITH {LAGGED}, c AS (SELECT pixel_id, count(*) AS n, corr(x, v) AS a, corr(x, month(week_end)) AS b, corr(v, month(week_end)) AS c FROM pairs WHERE lag = 0 GROUP BY 1) SELECT pixel_id, n, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS r FROM c""")
def partial_correlation(spark, sf_dir):
    rows = lagged_pairs(spark, sf_dir).where("lag = 0").withColumn("z", F.month("week_end").cast("double"))
    return rounded(inference.partial_correlation(rows, ["pixel_id"], "x", "v", "z"))


@query(f"""WITH {CUBE_WEEKLY}, s AS (SELECT pixel_id, year(week_end) AS y, avg(v) FILTER (month(week_end) <= 6) AS a, avg(v) FILTER (month(week_end) > 6) AS b FROM cw GROUP BY ALL), d AS (SELECT pixel_id, a - b AS d, round(abs(a - b), 9) AS m FROM s WHERE a - b <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY pixel_id ORDER BY m) + (count(*) OVER (PARTITION BY pixel_id, m) - 1) / 2.0 AS r FROM d), t AS (SELECT pixel_id, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM r GROUP BY 1)
SELECT *, round(CASE WHEN n >= 5 THEN (least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0) END, 6) AS z FROM t""")
def wilcoxon_paired(spark, sf_dir):
    rows = cube_weekly(spark, sf_dir).groupBy("pixel_id", F.year("week_end").alias("y")).agg(F.avg(F.when(F.month("week_end") <= 6, F.col("v"))).alias("a"), F.avg(F.when(F.month("week_end") > 6, F.col("v"))).alias("b"))
    return rounded(inference.wilcoxon(rows, ["pixel_id"], "a", "b"))


@query(f"WITH {CUBE} SELECT pixel_id, count(*) AS n, round(1 + count(*) / sum(ln(v / 40)), 6) AS alpha FROM cube WHERE v >= 40 GROUP BY 1")
def power_law_tail(spark, sf_dir):
    return rounded(inference.power_tail(cube_daily(spark, sf_dir), ["pixel_id"], "v", 40.0))


@query(f"""WITH {LAGGED}, z AS (SELECT pixel_id, year(week_end) AS e, week_end, x, v FROM pairs WHERE lag = 0), a AS (SELECT *, x - avg(x) OVER (PARTITION BY pixel_id) AS cx, v - avg(v) OVER (PARTITION BY pixel_id) AS cv, regr_slope(v, x) OVER (PARTITION BY pixel_id) AS b FROM z),
g AS (SELECT *, cx * (cv - b * cx) AS g FROM a), m AS (SELECT *, g * g + 2 * (1 - 1 / 3.0::DOUBLE) * coalesce(g * lag(g, 1) OVER w, 0) + 2 * (1 - 2 / 3.0::DOUBLE) * coalesce(g * lag(g, 2) OVER w, 0) AS mt FROM g WINDOW w AS (PARTITION BY pixel_id, e ORDER BY week_end))
SELECT pixel_id, count(*) AS n, count(DISTINCT e) AS n_events, round(any_value(b), 10) AS slope, round(any_value(b) / (sqrt(greatest(0, sum(mt))) / sum(cx * cx)), 5) AS t FROM m GROUP BY 1""")
def event_hac_regression(spark, sf_dir):
    rows = lagged_pairs(spark, sf_dir).where("lag = 0").withColumn("e", F.year("week_end"))
    out = inference.event_regression(rows, "e", "x", "v", "week_end", keys=("pixel_id",))
    return out.select("pixel_id", "n", "n_events", F.round("slope", 10).alias("slope"), F.round("t", 5).alias("t"))


@query(f"""WITH {CUBE_WEEKLY}, e AS (SELECT pixel_id, year(week_end) AS y, avg(v) AS v FROM cw GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY y) - 1 AS i, count(*) OVER (PARTITION BY pixel_id) AS n FROM e),
t AS (SELECT pixel_id, draw, ('0x' || substr(md5('42|' || draw || '|' || i), 1, 8))::BIGINT * n // 4294967296 AS i FROM k, range(200) r(draw)), m AS (SELECT t.pixel_id, draw, avg(v) AS m FROM t JOIN k USING (pixel_id, i) GROUP BY ALL)
SELECT k.pixel_id, any_value(n) AS n_units, round(any_value(mean), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM k JOIN (SELECT pixel_id, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) USING (pixel_id) JOIN (SELECT pixel_id, avg(v) AS mean FROM e GROUP BY 1) USING (pixel_id) GROUP BY 1""")
def bootstrap_mean(spark, sf_dir):
    rows = cube_weekly(spark, sf_dir).withColumn("y", F.year("week_end"))
    return rounded(inference.bootstrap_mean(rows, ["pixel_id"], "v", "y", 200))


def field_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly signal against the whole field of cells at the lags of ``lagged_pairs``, in weeks."""
    return inference.field_significance(weekly_signal(spark, sf_dir), cube_weekly(spark, sf_dir), "pixel_id", "week_end", "x", "v", tuple(k // 7 for k in LAGS))


@query()
def field_significance_max_lag(spark, sf_dir):
    """Field significance with every admissible offset and the correction for the search over lags."""
    return rounded(field_test(spark, sf_dir))


@query()
def confirmatory_gate(spark, sf_dir):
    rows = lagged_pairs(spark, sf_dir).where("lag = 0")
    r = stats.grouped_correlation(rows, ["pixel_id"], "x", "v")
    q = stats.benjamini_hochberg(r.withColumn("p", stats.p_of_r("r", "n")), [])
    keep = stats.leave_one_out(rows.withColumn("event", F.year("week_end")), "event", "x", "v", ("pixel_id",)).groupBy("pixel_id").agg(F.avg(F.col("same_sign").cast("double")).alias("same"), F.count("*").alias("events"))
    field = field_test(spark, sf_dir).where("lag = 0").select("p_field")
    out = q.join(keep, "pixel_id").crossJoin(F.broadcast(field))
    return rounded(out.withColumn("verdict", inference.confirmatory_gate(out, "q", "p_field", "same", "events")))


@query(f"""WITH {LAGGED}, i AS (SELECT pixel_id, week_end, year(week_end)::INT AS e, v, row_number() OVER (PARTITION BY pixel_id, year(week_end) ORDER BY week_end) - 1 AS i, count(*) OVER (PARTITION BY pixel_id, year(week_end)) AS n FROM pairs WHERE lag = 0)
SELECT a.pixel_id, a.week_end, a.e, b.v AS rolled FROM i a JOIN i b ON a.pixel_id = b.pixel_id AND a.e = b.e AND (b.i + 5) % b.n = a.i""")
def circular_event_roll(spark, sf_dir):
    rows = lagged_pairs(spark, sf_dir).where("lag = 0").select("pixel_id", "week_end", F.year("week_end").alias("e"), "v")
    return inference.rolled_events(rows, "e", "week_end", "v", 5, ("pixel_id",)).drop("v")


# ---- scalars and audits


@query(f"""WITH {SIGNAL} SELECT d, round(sin(2 * pi() * (dayofyear(d) - 1) / 365.2425), 9) AS sin1, round(cos(2 * pi() * (dayofyear(d) - 1) / 365.2425), 9) AS cos1, round(sin(4 * pi() * (dayofyear(d) - 1) / 365.2425), 9) AS sin2 FROM signal""")
def fourier_calendar(spark, sf_dir):
    _, s1, c1, s2, *_ = fourier_design("d", 2)
    return rounded(signal_daily(spark, sf_dir).select("d", s1.alias("sin1"), c1.alias("cos1"), s2.alias("sin2")), 9)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders")
def tolerant_dates(spark, sf_dir):
    number = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(20011399)).otherwise(F.date_format("o_orderdate", "yyyyMMdd").cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.tolerant_date(number).alias("parsed"))


@query("""SELECT p_brand, p_partkey, CAST(dense_rank() OVER w AS INT) AS dense, CAST(rank() OVER w AS INT) AS lowest, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INT) AS ordinal
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)""")
def ranks(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"))
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.dense_rank().over(w).alias("dense"), F.rank().over(w).alias("lowest"), F.row_number().over(w.orderBy(F.desc("p_size"), "p_partkey")).alias("ordinal"))


@query(f"WITH {CUBE} SELECT count(*) AS n, count(DISTINCT pixel_id) AS cells, min(d) AS first, max(d) AS last, count(v) AS valid, count(DISTINCT d) AS days FROM cube")
def dataset_summary(spark, sf_dir):
    return cube_daily(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("pixel_id").alias("cells"), F.min("d").alias("first"), F.max("d").alias("last"), F.count("v").alias("valid"), F.countDistinct("d").alias("days"))


@query(f"WITH {SIGNAL}, w AS (SELECT DISTINCT d + (7 - isodow(d))::INT AS week_end FROM signal), g AS (SELECT week_end, week_end - lag(week_end) OVER (ORDER BY week_end) AS gap FROM w) SELECT count(*) AS n, bool_and(dayofweek(week_end) = 0) AS sundays, coalesce(bool_and(gap = 7), true) AS contiguous FROM g")
def weekly_index_contract(spark, sf_dir):
    w = weekly_signal(spark, sf_dir).select("week_end").withColumn("gap", F.datediff("week_end", F.lag("week_end").over(Window.orderBy("week_end"))))
    return w.agg(F.count("*").alias("n"), F.bool_and(F.dayofweek("week_end") == 1).alias("sundays"), F.coalesce(F.bool_and(F.col("gap") == 7), F.lit(True)).alias("contiguous"))


@query(f"WITH {CUBE} SELECT d, {', '.join(f'max(v) FILTER (pixel_id = {k}) AS cell_{k}' for k in range(25))}, month(d)::INT AS month FROM cube GROUP BY d")
def feature_matrix(spark, sf_dir):
    """A column for every cell; the cells are the nations, with or without values."""
    cells = sorted(r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").distinct().collect())
    rows = cube_daily(spark, sf_dir).withColumn("name", F.concat(F.lit("cell_"), F.col("pixel_id")))
    return rows.groupBy("d").pivot("name", [f"cell_{k}" for k in cells]).agg(F.max("v")).withColumn("month", F.month("d"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, round(o_totalprice * 2, 4) FROM orders WHERE o_custkey % 2 = 1")
def upserted_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    new = rows.where(F.col("o_custkey") % 2 == 1).withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 4))
    return sinks.upserted(rows, new, ["o_orderkey"])


@query("SELECT event_id, ts, event_type FROM events WHERE CAST(ts AS DATE) <= CASE event_type WHEN 'click' THEN DATE '2024-01-20' - 5 WHEN 'view' THEN DATE '2024-01-20' - 15 ELSE DATE '2024-01-20' END")
def available_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type").withColumn("d", F.to_date("ts"))
    return readers.available(rows, "event_type", "d", {"click": 5, "view": 15}, "2024-01-20").drop("d")


@query(f"""SELECT DATE '1981-01-04' + (k * 7)::INT AS week_end, true AS is_synthetic, {', '.join(f"round(sin(k * (2 * 3.141592653589793::DOUBLE / 52.1775::DOUBLE) + {i}) + (('0x' || substr(md5(k || '|{i}'), 1, 8))::BIGINT % 2001 - 1000) / 1000.0::DOUBLE, 6) AS v{i}" for i in range(5))} FROM range(200) t(k)""")
def synthetic_series(spark, sf_dir):
    return rounded(readers.synthetic_weekly(spark, 200, 5))


# ---- streams: the same rows as the batch at the end of the input


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.with_event_time(st.stream_of(spark, f"{sf_dir}/events.parquet"), "ts", "40 days")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS d, event_type, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily(spark, sf_dir):
    rows = st.drained(st.tumbling(_events_stream(spark, sf_dir), "ts", ["event_type"], "value"), "complete")
    return rows.select(F.col("start").cast("date").alias("d"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT CAST(ts AS DATE) + (7 - isodow(ts))::INT AS week_end, event_type, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_weekly(spark, sf_dir):
    return rounded(st.drained(st.weekly(_events_stream(spark, sf_dir), "ts", ["event_type"], "value"), "complete"))


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b, value FROM events WHERE value > 1), s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, count(*) AS n, max(value) AS top FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    return st.drained(st.sessions(_events_stream(spark, sf_dir), "ts", ["user_id"], "value", 1.0, "6 hours"), "complete").select("user_id", "n", "top")


@query("""WITH w AS (SELECT event_type, CAST(ts AS DATE) - k::INT AS start, value FROM events, range(5) t(k)) SELECT start, event_type, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    """Sums of five days, each day a new window."""
    rows = st.drained(st.sliding(_events_stream(spark, sf_dir), "ts", ["event_type"], "value"), "complete")
    return rows.select(F.col("start").cast("date").alias("start"), "event_type", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_latest_rows(spark, sf_dir):
    """Each task and kind once, whatever comes again within the watermark."""
    return st.drained(st.latest_rows(_events_stream(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"), "append").distinct()


@query("""WITH o AS (SELECT user_id, ts, value, value > 0.5 AS is_on, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, is_on ORDER BY ts) AS run FROM o),
g AS (SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS n, max(value) AS top FROM r WHERE is_on GROUP BY user_id, run), m AS (SELECT user_id, max(i) AS last FROM o GROUP BY 1)
SELECT g.user_id, row_number() OVER (PARTITION BY g.user_id ORDER BY first) - 1 AS run, n, top FROM g JOIN m USING (user_id) WHERE g.last < m.last""")
def stream_open_runs(spark, sf_dir):
    """Runs over a limit of each task, kept as state while they are open."""
    return st.drained(st.open_runs(_events_stream(spark, sf_dir), "user_id", "ts", "value", 0.5), "append")


@query("""WITH m AS (SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, avg(value) AS value FROM events GROUP BY 1, 2) SELECT event_type, max(month) AS month, round(arg_max(value, month), 6) AS value FROM m WHERE last_day(month) + 15 <= DATE '2024-12-31' GROUP BY 1""")
def stream_latest_release(spark, sf_dir):
    """Of each source the newest monthly value that is released by a day, fifteen days after its month."""
    monthly = st.drained(st.monthly(_events_stream(spark, sf_dir), "ts", ["event_type"], "value"), "complete")
    out = monthly.where(F.date_add(F.last_day("month"), 15) <= F.lit("2024-12-31").cast("date")).groupBy("event_type")
    return rounded(out.agg(F.max("month").alias("month"), F.max_by("mean", "month").alias("value")))


@query("""WITH c AS (SELECT corr(l_quantity, l_discount) AS r1, var_samp(l_quantity) AS a, var_samp(l_discount * 100) AS b, covar_samp(l_quantity, l_discount * 100) AS c FROM lineitem), e AS (SELECT a + b AS total, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS first FROM c)
SELECT 1 AS components, round(first / total, 6) AS share FROM e UNION ALL SELECT 2, 1.0::DOUBLE FROM e""")
def explained_variance(spark, sf_dir):
    """Cumulated share of the variance of two variables that their principal components explain."""
    from ..operators.models import explained

    rows = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("id"), F.array(F.col("l_quantity"), F.col("l_discount") * 100).alias("v"))
    shares, _ = explained(rows, "id", "v", 2)
    return rounded(spark.createDataFrame([(k + 1, v) for k, v in enumerate(shares)], "components int, share double"))
