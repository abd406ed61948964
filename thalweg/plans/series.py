"""Registered queries on series and fields: calendars, climatologies, windows, events, grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import climatology as clim
from ..operators import events as ev
from ..operators import grid
from ..operators import windows as win
from ..sources.views import CUBE, MONTHLY, SIGNAL, cube_daily, monthly_signal, signal_daily, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BASE = ("1995-01-01", "1999-12-31")


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, for sums in another order differ in their last digits."""
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


ONI = f"""{MONTHLY}, anom AS (SELECT month, m - avg(m) OVER (PARTITION BY month(month)) AS a FROM monthly),
smooth AS (SELECT month, CASE WHEN count(a) OVER w = 3 THEN avg(a) OVER w END AS s FROM anom WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
oni AS (SELECT month, s / stddev_pop(s) OVER () AS oni FROM smooth)"""
EVENTS = f"""{ONI}, signed AS (SELECT month, oni, CASE WHEN oni >= 0.5 THEN 1 WHEN oni <= -0.5 THEN -1 ELSE 0 END AS sign FROM oni WHERE oni IS NOT NULL),
runs AS (SELECT *, year(month) * 12 + month(month) - row_number() OVER (PARTITION BY sign ORDER BY month) AS run FROM signed),
ev AS (SELECT sign, min(month) AS onset, max(month) AS "end", count(*) AS months, arg_max(month, abs(oni) * 1e9 - (year(month) * 12 + month(month)) * 1e-4) AS peak_time,
  arg_max(oni, abs(oni) * 1e9 - (year(month) * 12 + month(month)) * 1e-4) AS peak_value FROM runs WHERE sign <> 0 GROUP BY sign, run HAVING count(*) >= 3),
events_t AS (SELECT CASE WHEN sign > 0 THEN 'warm' ELSE 'cold' END AS event_type, onset, peak_time, "end", months, peak_value,
  (CASE WHEN sign > 0 THEN 'warm' ELSE 'cold' END) || '_' || CASE WHEN year(onset) = year("end") THEN year(onset)::VARCHAR ELSE year(onset) || '_' || year("end") END AS event_id FROM ev)"""
BANDS = f"""{EVENTS}, inside AS (SELECT e.event_id, e.peak_time, o.month FROM events_t e JOIN oni o ON o.month BETWEEN e.onset AND e."end" WHERE abs(o.oni) >= abs(e.peak_value) * 0.8),
marked AS (SELECT *, year(month) * 12 + month(month) - row_number() OVER (PARTITION BY event_id ORDER BY month) AS run FROM inside),
bands AS (SELECT event_id, min(month) AS peak_band_start, last_day(max(month)) AS peak_band_end FROM marked GROUP BY event_id, run HAVING max((month = peak_time)::INT) = 1)"""
PHASES = f"""{BANDS}, weeks AS (SELECT DISTINCT d + (7 - isodow(d))::INT AS week_end FROM signal),
joined AS (SELECT e.*, b.peak_band_start, b.peak_band_end, last_day(e."end") AS close FROM events_t e JOIN bands b USING (event_id)),
hits AS (SELECT w.week_end, j.*, w.week_end >= j.onset AS active FROM weeks w JOIN joined j ON w.week_end <= j.close AND w.week_end >= j.onset - 182),
held AS (SELECT *, row_number() OVER (PARTITION BY week_end ORDER BY active DESC, CASE WHEN active THEN onset END DESC, CASE WHEN NOT active THEN onset END) AS k FROM hits),
phases AS (SELECT w.week_end, coalesce(h.event_type, 'neutral') AS event_type,
  CASE WHEN h.event_id IS NULL THEN 'neutral' WHEN NOT h.active THEN 'genesis' WHEN w.week_end < h.peak_band_start THEN 'growth' WHEN w.week_end <= h.peak_band_end THEN 'peak' ELSE 'decay' END AS phase,
  h.event_id, floor((w.week_end - h.peak_time) / 7.0)::BIGINT AS weeks_from_peak FROM weeks w LEFT JOIN held h ON h.week_end = w.week_end AND h.k = 1)"""
WEEKLY = f"{SIGNAL}, weekly AS (SELECT d + (7 - isodow(d))::INT AS week_end, avg(x) AS x, count(x) AS n FROM signal GROUP BY 1)"
CUBE_WEEKLY = f"{CUBE}, cw AS (SELECT pixel_id, d + (7 - isodow(d))::INT AS week_end, sum(v) AS v FROM cube GROUP BY ALL)"


def oni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, oni): monthly anomaly, centred three-month mean, in deviations."""
    rows = clim.monthly_anomaly(monthly_signal(spark, sf_dir))
    rows = rows.withColumn("s", win.centred_mean("anomaly", 3, 3, [], "month"))
    return rows.select("month", (F.col("s") / F.stddev_pop("s").over(Window.partitionBy())).alias("oni"))


def events(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    return ev.threshold_events(oni(spark, sf_dir), least=least)


def phase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, series = events(spark, sf_dir), oni(spark, sf_dir)
    weeks = signal_daily(spark, sf_dir).select(cal.week_end("d").alias("week_end")).distinct()
    return ev.lifecycle(weeks, e, ev.peak_band(e, series, 0.8))


def weekly_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_daily(spark, sf_dir).groupBy(cal.week_end("d").alias("week_end")).agg(F.avg("x").alias("x"), F.count("x").alias("n"))


def cube_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_daily(spark, sf_dir).groupBy("pixel_id", cal.week_end("d").alias("week_end")).agg(F.sum("v").alias("v"))


@query(f"WITH {EVENTS} SELECT event_id, event_type, onset, peak_time, \"end\", months, round(peak_value, 6) AS peak_value FROM events_t")
def enso_events(spark, sf_dir):
    return rounded(events(spark, sf_dir))


@query(f"WITH {BANDS} SELECT * FROM bands")
def peak_band(spark, sf_dir):
    return ev.peak_band(events(spark, sf_dir), oni(spark, sf_dir), 0.8)


@query(f"WITH {PHASES} SELECT * FROM phases")
def lifecycle_weekly(spark, sf_dir):
    return phase_table(spark, sf_dir)


@query(f"WITH {PHASES} SELECT week_end, CASE WHEN event_type = 'neutral' THEN 'neutral' ELSE event_type || '_' || phase END AS state, coalesce(event_id, 'neutral_' || year(week_end) || 'Q' || quarter(week_end)) AS group_id FROM phases")
def state_groups(spark, sf_dir):
    return ev.group_id(phase_table(spark, sf_dir)).select("week_end", ev.state_label().alias("state"), "group_id")


@query(f"""WITH {EVENTS} SELECT event_id, round(abs(peak_value), 6) AS peak_size, round((peak_time - onset) / 7.0, 6) AS weeks_to_peak, round(("end" - onset) / 7.0, 6) AS weeks_to_end,
dense_rank() OVER (ORDER BY abs(peak_value) DESC) AS intensity_rank FROM events_t""")
def event_targets(spark, sf_dir):
    return rounded(ev.event_targets(events(spark, sf_dir)))


@query(f"""WITH {ONI}, o AS (SELECT month, oni >= 0.3 AS is_on, oni FROM oni WHERE oni IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY month) - row_number() OVER (PARTITION BY is_on ORDER BY month) AS run FROM o),
g AS (SELECT min(month) AS start, max(month) AS "end", count(*) AS months, max(oni) AS top FROM r WHERE is_on GROUP BY run HAVING count(*) >= 2)
SELECT start, "end", months, round(top, 6) AS top, row_number() OVER (ORDER BY start)::INT AS run_no FROM g""")
def warm_runs_gap_tolerant(spark, sf_dir):
    return rounded(ev.gap_tolerant_runs(oni(spark, sf_dir), "oni", "month", 0.3, 2))


@query(f"WITH {SIGNAL} SELECT d + (7 - isodow(d))::INT AS week_end, round(CASE WHEN count(x) >= 7 THEN avg(x) END, 4) AS x FROM signal GROUP BY 1")
def weekly_complete_mean(spark, sf_dir):
    return rounded(cal.weekly_mean(signal_daily(spark, sf_dir), value="x"), 4)


@query(f"""WITH {CUBE}, b AS (SELECT min(d) AS lo, max(d) AS hi FROM cube),
w AS (SELECT pixel_id, d + (7 - isodow(d))::INT AS week_end, sum(v) AS s, count(v) AS valid_days FROM cube GROUP BY ALL),
e AS (SELECT w.*, (least(week_end, hi) - greatest(week_end - 6, lo) + 1)::INT AS expected_days FROM w, b)
SELECT pixel_id, week_end, CASE WHEN valid_days >= 7 AND expected_days = 7 THEN s END AS total, valid_days, expected_days, expected_days < 7 AS is_partial FROM e""")
def weekly_sum_flags(spark, sf_dir):
    return cal.weekly_sum(cube_daily(spark, sf_dir), ["pixel_id"])


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type FROM events), c AS (SELECT d + (7 - isodow(d))::INT AS week_end, event_type, count(*) AS n FROM e GROUP BY ALL)
SELECT week_end, arg_min(event_type, (-n, event_type)) AS mode FROM c GROUP BY 1""")
def weekly_mode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), "event_type")
    return cal.weekly_mode(rows, value="event_type")


@query(f"""WITH {SIGNAL} SELECT CAST(date_trunc('month', d) AS DATE) AS month, round(avg(x), 4) AS mean, count(x) AS valid_days, count(x) >= day(last_day(min(d))) AS is_complete FROM signal GROUP BY 1""")
def monthly_reference(spark, sf_dir):
    return rounded(cal.monthly_mean(signal_daily(spark, sf_dir)), 4)


@query("SELECT CAST(ts AS DATE) AS d, event_type, round(avg(value), 6) AS value_mean, round(sum(value), 4) AS value_sum, count(*) AS n FROM events GROUP BY 1, 2")
def daily_from_subdaily(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return cal.daily(rows, "ts", ["value"], ["value"], ["event_type"]).select("d", "event_type", F.round("value_mean", 6).alias("value_mean"), F.round("value_sum", 4).alias("value_sum"), "n")


@query(f"""WITH {SIGNAL}, a AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM signal) SELECT a.d FROM a ANTI JOIN signal USING (d)""")
def missing_steps(spark, sf_dir):
    return cal.missing_steps(signal_daily(spark, sf_dir))


@query(f"""WITH {SIGNAL}, a AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM signal) SELECT a.d, round(x, 4) AS x FROM a LEFT JOIN signal USING (d)""")
def calendar_densified(spark, sf_dir):
    return rounded(cal.densified(signal_daily(spark, sf_dir)), 4)


@query(f"WITH {SIGNAL} SELECT DATE '1981-01-06' + (floor((d - DATE '1981-01-06') / 7.0) * 7)::INT AS bin_start, round(avg(x), 4) AS mean, count(x) AS n FROM signal GROUP BY 1")
def anchored_seven_day_bins(spark, sf_dir):
    return rounded(cal.anchored_bins(signal_daily(spark, sf_dir), "1981-01-06"), 4)


@query(f"""WITH {CUBE} SELECT d, round(sum(v * cos(radians(lat))) / sum(cos(radians(lat))), 6) AS index FROM cube
WHERE lat BETWEEN -5 AND 10 AND (lon >= 300 OR lon <= 120) GROUP BY d""")
def box_index_wrap(spark, sf_dir):
    return rounded(grid.box_index(cube_daily(spark, sf_dir), -5, 10, 300, 120))


@query(f"""WITH {CUBE}, w AS (SELECT d, avg(v) AS west FROM cube WHERE lat BETWEEN -10 AND 10 AND lon BETWEEN 20 AND 170 GROUP BY d), e AS (SELECT d, avg(v) AS east FROM cube WHERE lat BETWEEN -10 AND 0 AND lon BETWEEN 170 AND 340 GROUP BY d)
SELECT d, round(west, 6) AS west, round(east, 6) AS east, round(west - east, 6) AS dipole FROM w JOIN e USING (d)""")
def dipole_index(spark, sf_dir):
    return rounded(grid.dipole_index(cube_daily(spark, sf_dir), (-10, 10, 20, 170), (-10, 0, 170, 340)))


@query(f"""WITH {CUBE}, m AS (SELECT n_nationkey AS pixel_id, r_name AS unit, cos(radians(n_regionkey * 5.0::DOUBLE - 10.0)) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT unit, sum(weight) AS whole FROM m GROUP BY 1), s AS (SELECT d, unit, sum(v * weight) AS s, sum(weight) AS w FROM cube JOIN m USING (pixel_id) GROUP BY ALL)
SELECT d, unit, round(CASE WHEN w / whole >= 0.6 THEN s / w END, 6) AS mean, round(w / whole, 6) AS coverage FROM s JOIN t USING (unit)""")
def area_weighted_units(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    member = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("pixel_id"), F.col("r_name").alias("unit"), F.cos(F.radians(F.col("n_regionkey") * 5.0 - 10.0)).alias("weight"))
    return rounded(grid.unit_mean(cube_daily(spark, sf_dir), member, 0.6))


@query(f"""WITH {CUBE} SELECT d, (pixel_id // 5) // 2 AS "row", (pixel_id % 5) // 2 AS col, CASE WHEN count(v) = 4 THEN avg(v) END AS v FROM cube GROUP BY ALL""")
def coarsen(spark, sf_dir):
    rows = cube_daily(spark, sf_dir).select("d", F.floor(F.col("pixel_id") / 5).alias("row"), (F.col("pixel_id") % 5).alias("col"), "v")
    return grid.coarsen(rows, 2, keys=("d",)).select("d", "row", "col", "v")


@query("""WITH c AS (SELECT n_nationkey AS pixel_id, n_nationkey || ',' || format('{:.8f}', n_regionkey * 5.0::DOUBLE - 10.0) || ',' || format('{:.8f}', n_nationkey * 14.4::DOUBLE) AS cell FROM nation)
SELECT sha256(string_agg(cell, ';' ORDER BY pixel_id)) AS fingerprint FROM c""")
def grid_hash(spark, sf_dir):
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pixel_id"), (F.col("n_regionkey") * 5.0 - 10.0).alias("lat"), (F.col("n_nationkey") * 14.4).alias("lon"))
    return grid.grid_hash(cells)


@query("""SELECT n_nationkey AS pixel_id, round(fmod(n_nationkey * 14.4::DOUBLE + 120.0, 360.0), 6) AS lon360, round(fmod(n_nationkey * 14.4::DOUBLE + 120.0 + 180.0, 360.0) - 180.0, 6) AS lon180,
(n_nationkey // 5) * 5 + n_nationkey % 5 AS row_major FROM nation""")
def longitude_conventions(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("lon", F.col("n_nationkey") * 14.4 + 120.0)
    return rounded(rows.select(F.col("n_nationkey").alias("pixel_id"), grid.longitude("lon").alias("lon360"), grid.longitude("lon", "-180_180").alias("lon180"), grid.pixel_id(F.floor(F.col("n_nationkey") / 5), F.col("n_nationkey") % 5, 5).alias("row_major")))


@query("WITH l AS (SELECT DISTINCT n_regionkey * 5.0::DOUBLE - 10.0 AS lat FROM nation), g AS (SELECT lat, lat - lag(lat) OVER (ORDER BY lat) AS gap FROM l) SELECT count(lat) AS n, min(gap) AS step, max(gap) - min(gap) <= 1e-7 AS is_regular FROM g")
def grid_regularity(spark, sf_dir):
    return grid.regularity(table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 5.0 - 10.0).alias("lat")), "lat")


DOY = f"""{SIGNAL}, slots AS (SELECT dayofyear(d)::INT AS doy, avg(x) AS c, stddev_samp(x) AS s FROM signal WHERE d BETWEEN DATE '{BASE[0]}' AND DATE '{BASE[1]}' GROUP BY 1),
near AS (SELECT ((doy + o - 1 + 366) % 366 + 1)::INT AS doy, c, s FROM slots, range(-7, 8) t(o)), dclim AS (SELECT doy, avg(c) AS clim, avg(s) AS sd FROM near GROUP BY 1)"""


@query(f"WITH {DOY} SELECT doy, round(clim, 4) AS clim, round(sd, 4) AS sd FROM dclim")
def doy_climatology(spark, sf_dir):
    return rounded(clim.doy_climatology(signal_daily(spark, sf_dir), base=BASE), 4)


@query(f"WITH {DOY} SELECT d, round(x - clim, 6) AS anomaly FROM signal LEFT JOIN dclim ON doy = dayofyear(d)")
def doy_anomaly(spark, sf_dir):
    rows = signal_daily(spark, sf_dir)
    return rounded(clim.daily_anomaly(rows, clim.doy_climatology(rows, base=BASE)).select("d", "anomaly"))


@query(f"WITH {DOY} SELECT d, round((x - clim) / nullif(sd, 0), 6) AS standardized FROM signal LEFT JOIN dclim ON doy = dayofyear(d)")
def standardized_anomaly(spark, sf_dir):
    rows = signal_daily(spark, sf_dir)
    return rounded(clim.daily_anomaly(rows, clim.doy_climatology(rows, base=BASE)).select("d", "standardized"))


@query(f"WITH {CUBE_WEEKLY} SELECT pixel_id, week_end, round((v - avg(v) FILTER (b) OVER (PARTITION BY pixel_id)) / stddev_samp(v) FILTER (b) OVER (PARTITION BY pixel_id), 6) AS z FROM (SELECT *, year(week_end) <= 1999 AS b FROM cw)")
def base_zscore(spark, sf_dir):
    return rounded(clim.base_zscore(cube_weekly(spark, sf_dir), F.year("week_end") <= 1999, ["pixel_id"], "v").select("pixel_id", "week_end", "z"))


@query(f"""WITH {CUBE_WEEKLY}, r AS (SELECT *, weekofyear(week_end)::INT AS week FROM cw),
spread AS (SELECT pixel_id, week AS w, v FROM r UNION ALL SELECT pixel_id, 53, v FROM r WHERE week IN (52, 1)),
c AS (SELECT pixel_id, w AS week, median(v) AS slot, count(v) AS n FROM spread GROUP BY ALL), p AS (SELECT pixel_id, median(v) AS pooled FROM r GROUP BY 1),
j AS (SELECT r.*, CASE WHEN n >= 3 THEN slot ELSE pooled END AS centre FROM r LEFT JOIN c USING (pixel_id, week) LEFT JOIN p USING (pixel_id)),
k AS (SELECT *, abs(v - centre) AS dev FROM j), s AS (SELECT pixel_id, week, median(dev) * 1.4826 AS mad_season FROM k GROUP BY ALL), t AS (SELECT pixel_id, median(dev) * 1.4826 AS mad_pool, avg(dev) * sqrt(pi() / 2) AS l1_pool FROM k GROUP BY 1),
z AS (SELECT k.*, CASE WHEN mad_season >= 0.1 THEN mad_season END AS a, CASE WHEN mad_pool >= 0.1 THEN mad_pool END AS b, CASE WHEN l1_pool >= 0.1 THEN l1_pool END AS e FROM k JOIN s USING (pixel_id, week) JOIN t USING (pixel_id))
SELECT pixel_id, week_end, round(centre, 6) AS centre, round(greatest(a, b, e), 6) AS scale, CASE WHEN a = greatest(a, b, e) THEN 'mad_season' WHEN b = greatest(a, b, e) THEN 'mad_pool' ELSE 'l1_pool' END AS scale_source,
round((v - centre) / greatest(a, b, e), 6) AS z FROM z""")
def iso_week_robust(spark, sf_dir):
    return rounded(clim.iso_week_robust(cube_weekly(spark, sf_dir), ["pixel_id"]).select("pixel_id", "week_end", "centre", "scale", "scale_source", "z"))


@query(f"""WITH {SIGNAL}, r AS (SELECT d, x, CASE WHEN d < DATE '1998-01-01' THEN 'old' ELSE 'new' END AS source, (d - DATE '1970-01-01')::DOUBLE AS t FROM signal),
f AS (SELECT source, regr_slope(x, t) AS slope, avg(t) AS centre FROM r WHERE year(d) <= 1999 GROUP BY 1)
SELECT d, source, round(x - slope * (t - centre), 3) AS detrended FROM r JOIN f USING (source)""")
def source_detrend(spark, sf_dir):
    rows = signal_daily(spark, sf_dir).withColumn("source", F.when(F.col("d") < "1998-01-01", "old").otherwise("new"))
    return rounded(clim.source_detrended(rows, ["source"], F.year("d") <= 1999).select("d", "source", "detrended"), 3)


@query()
def harmonic_anomaly(spark, sf_dir):
    rows = clim.harmonic_anomaly(signal_daily(spark, sf_dir), base=F.col("d").between(*[F.lit(b).cast("date") for b in BASE]))
    return rounded(rows.select("d", "fitted", "anomaly"), 4)


@query()
def spi_gamma(spark, sf_dir):
    return rounded(clim.spi(cube_weekly(spark, sf_dir), ["pixel_id"]).select("pixel_id", "week_end", "accumulated", "spi"))


@query(f"""WITH {CUBE} SELECT pixel_id, count(v) AS n, round(quantile_cont(v, 0.1), 6) AS p10, quantile_cont(v, 0.5) AS p50, round(quantile_cont(v, 0.9), 6) AS p90,
CASE WHEN count(v) >= 100 THEN round(quantile_cont(v, 0.975), 6) END AS p97p5 FROM cube WHERE year(d) <= 1999 GROUP BY 1""")
def percentile_thresholds(spark, sf_dir):
    from ..operators.tables import quantiles

    rows = cube_daily(spark, sf_dir).where(F.year("d") <= 1999)
    one = quantiles(rows, ["pixel_id"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return rounded(one.join(quantiles(rows, ["pixel_id"], "v", {"p97p5": 0.975}, 100).drop("n"), "pixel_id"))


@query(f"""WITH {CUBE}, q AS (SELECT pixel_id, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM cube GROUP BY 1) SELECT d, pixel_id, v <= lo AS is_dry, v >= hi AS is_wet FROM cube JOIN q USING (pixel_id)""")
def dry_wet_mask(spark, sf_dir):
    return ev.dry_wet(cube_daily(spark, sf_dir), ["pixel_id"]).select("d", "pixel_id", "is_dry", "is_wet")


@query(f"WITH {CUBE_WEEKLY} SELECT pixel_id, week_end, CASE WHEN count(v) OVER w = 4 THEN sum(v) OVER w END AS total FROM cw WINDOW w AS (PARTITION BY pixel_id ORDER BY week_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def rolling_accum(spark, sf_dir):
    return cube_weekly(spark, sf_dir).select("pixel_id", "week_end", win.trailing_sum("v", 4, ["pixel_id"], "week_end").alias("total"))


@query(f"WITH {WEEKLY} SELECT week_end, round(CASE WHEN count(x) OVER w >= 6 THEN avg(x) OVER w END, 4) AS smooth FROM weekly WINDOW w AS (ORDER BY week_end ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)")
def centred_rolling_mean(spark, sf_dir):
    return rounded(weekly_signal(spark, sf_dir).select("week_end", win.centred_mean("x", 13, 6, [], "week_end").alias("smooth")), 4)


@query(f"""WITH {CUBE_WEEKLY}, o AS (SELECT pixel_id, week_end, v > 60 AS is_on FROM cw), r AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY week_end) - row_number() OVER (PARTITION BY pixel_id, is_on ORDER BY week_end) AS run FROM o)
SELECT pixel_id, week_end, is_on, row_number() OVER (PARTITION BY pixel_id, is_on, run ORDER BY week_end)::INT AS duration FROM r""")
def run_duration(spark, sf_dir):
    rows = cube_weekly(spark, sf_dir).withColumn("is_on", F.col("v") > 60)
    return win.run_duration(rows, "is_on", ["pixel_id"], "week_end").select("pixel_id", "week_end", "is_on", "duration")


EXTREMES = f"""{CUBE}, wk AS (SELECT *, d + (7 - isodow(d))::INT AS week_end, v >= 30 AS wet FROM cube),
lim AS (SELECT pixel_id, CASE WHEN count(*) >= 100 THEN quantile_cont(v, 0.95) END AS lim FROM cube WHERE v >= 30 GROUP BY 1),
x AS (SELECT wk.*, lim, CASE WHEN count(v) OVER f = 5 THEN sum(v) OVER f END AS five, (d - DATE '1970-01-01') - row_number() OVER (PARTITION BY pixel_id, week_end, wet ORDER BY d) AS run
  FROM wk LEFT JOIN lim USING (pixel_id) WINDOW f AS (PARTITION BY pixel_id, week_end ORDER BY d RANGE BETWEEN INTERVAL 4 DAY PRECEDING AND CURRENT ROW)),
y AS (SELECT *, count(*) OVER (PARTITION BY pixel_id, week_end, wet, run) AS size FROM x)"""


@query(f"""WITH {EXTREMES} SELECT pixel_id, week_end, max(v) AS rx1, max(five) AS rx5, CASE WHEN max(lim) IS NOT NULL THEN sum(CASE WHEN v > lim THEN v ELSE 0 END) END AS r95,
coalesce(max(CASE WHEN NOT wet THEN size END), 0)::BIGINT AS cdd, coalesce(max(CASE WHEN wet THEN size END), 0)::BIGINT AS cwd FROM y GROUP BY 1, 2""")
def rx1_rx5_r95(spark, sf_dir):
    return ev.weekly_extremes(cube_daily(spark, sf_dir), ["pixel_id"], wet=30.0)


@query(f"""WITH {CUBE}, q AS (SELECT pixel_id, quantile_cont(v, 0.6) AS lim FROM cube GROUP BY 1), e AS (SELECT pixel_id, d, v - lim AS ex, (d - DATE '1970-01-01') AS n FROM cube JOIN q USING (pixel_id)),
r AS (SELECT *, n - row_number() OVER (PARTITION BY pixel_id ORDER BY d) AS run FROM e WHERE ex > 0)
SELECT pixel_id, min(d) AS onset, arg_min(d, (-ex, n)) AS peak_time, max(d) AS "end", count(*) AS days, round(max(ex), 6) AS top, round(avg(ex), 6) AS mean, round(sum(ex), 6) AS cumulative, round(sum(n * ex) / sum(ex), 3) AS centroid
FROM r GROUP BY pixel_id, run HAVING count(*) >= 4""")
def mhw_catalog(spark, sf_dir):
    rows = ev.percentile_runs(cube_daily(spark, sf_dir), ["pixel_id"], 0.6, 4)
    return rounded(rows.withColumn("centroid", F.round("centroid", 3)))


@query(f"""WITH {CUBE_WEEKLY} SELECT pixel_id, week_end, round(avg(v) OVER (PARTITION BY pixel_id ORDER BY week_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean_4, v - lag(v, 4) OVER w AS delta_4, round(avg(v) OVER (PARTITION BY pixel_id ORDER BY week_end ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 6) AS mean_13, v - lag(v, 13) OVER w AS delta_13
FROM cw WINDOW w AS (PARTITION BY pixel_id ORDER BY week_end)""")
def history_features(spark, sf_dir):
    return rounded(win.history_features(cube_weekly(spark, sf_dir), "v", (4, 13), ["pixel_id"], "week_end").drop("v"))


@query(f"WITH {CUBE_WEEKLY} SELECT pixel_id, week_end, lag(v, 1) OVER w AS v_lag1, lag(v, 4) OVER w AS v_lag4, lag(v, 13) OVER w AS v_lag13 FROM cw WINDOW w AS (PARTITION BY pixel_id ORDER BY week_end)")
def lag_features(spark, sf_dir):
    return win.lagged(cube_weekly(spark, sf_dir), "v", (1, 4, 13), ["pixel_id"], "week_end").drop("v")


@query(f"WITH {PHASES} SELECT week_end, coalesce(lead(phase, 4) OVER (ORDER BY week_end), 'out_of_sample') AS phase_lead4, coalesce(lead(phase, 13) OVER (ORDER BY week_end), 'out_of_sample') AS phase_lead13 FROM phases")
def lead_targets(spark, sf_dir):
    rows = win.led(phase_table(spark, sf_dir), "phase", (4, 13), [], "week_end")
    return rows.select("week_end", *[F.coalesce(c, F.lit("out_of_sample")).alias(c) for c in ("phase_lead4", "phase_lead13")])


@query(f"""WITH {WEEKLY}, s AS (SELECT *, CASE WHEN year(week_end) < 1997 THEN 1 WHEN year(week_end) < 2000 THEN 2 ELSE 3 END AS code FROM weekly),
j AS (SELECT week_end, code, lag(code) OVER w AS before_code, avg(x) OVER b AS before, avg(x) OVER a AS after, sqrt((var_samp(x) OVER b + var_samp(x) OVER a) / 2) AS sd
FROM s WINDOW w AS (ORDER BY week_end), b AS (ORDER BY week_end ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING), a AS (ORDER BY week_end ROWS BETWEEN CURRENT ROW AND 25 FOLLOWING))
SELECT week_end, code, before_code, round(before, 3) AS before, round(after, 3) AS after, round(sd, 3) AS sd, round((after - before) / sd, 3) AS z, abs((after - before) / sd) > 2 AS is_seam FROM j WHERE before_code <> code""")
def seam_audit(spark, sf_dir):
    rows = weekly_signal(spark, sf_dir).withColumn("code", F.when(F.year("week_end") < 1997, 1).when(F.year("week_end") < 2000, 2).otherwise(3))
    return rounded(win.seams(rows, "code", "x", [], "week_end"), 3)


@query(f"""WITH {SIGNAL}, a AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM signal), j AS (SELECT a.d, x IS NOT NULL AS ok FROM a LEFT JOIN signal USING (d)),
r AS (SELECT *, row_number() OVER (ORDER BY d) - row_number() OVER (PARTITION BY ok ORDER BY d) AS run FROM j), g AS (SELECT ok, run, count(*) AS size FROM r GROUP BY ALL)
SELECT (SELECT count(*) FROM j) AS n, round((SELECT avg(ok::INT) FROM j), 6) AS valid_share, (SELECT min(d) FROM j WHERE ok) AS first_valid, (SELECT max(d) FROM j WHERE ok) AS last_valid, coalesce((SELECT max(size) FROM g WHERE NOT ok), 0)::BIGINT AS longest_gap""")
def coverage_audit(spark, sf_dir):
    return rounded(win.coverage(cal.densified(signal_daily(spark, sf_dir)), "x", [], "d"))


@query(f"WITH {SIGNAL}, t AS (SELECT d, (x - lag(x) OVER (ORDER BY d)) / (d - lag(d) OVER (ORDER BY d)) AS tendency FROM signal) SELECT d, round(tendency, 7) AS tendency FROM t WHERE tendency IS NOT NULL")
def tendency(spark, sf_dir):
    return rounded(win.tendency(signal_daily(spark, sf_dir), "x", [], "d").select("d", "tendency"), 7)


@query(f"""WITH {CUBE}, w AS (SELECT d, avg(v) FILTER (lon BETWEEN 140 AND 220) AS w, avg(v) FILTER (lon BETWEEN 220 AND 330) AS e, regr_slope(v, lon) AS slope FROM cube GROUP BY d) SELECT d, round(e - w, 6) AS tilt, round(slope, 6) AS slope FROM w""")
def tilt(spark, sf_dir):
    from ..operators.vertical import tilt as op

    return rounded(op(cube_daily(spark, sf_dir), ["d"], (140.0, 220.0), (220.0, 330.0)))


@query("""SELECT event_id, round(sqrt(value * value + 9), 6) AS speed, round(1.22::DOUBLE * 1.3e-3 * sqrt(value * value + 9) * value, 12) AS stress FROM events""")
def wind_stress(spark, sf_dir):
    speed, stress = grid.wind_stress(F.col("value"), F.lit(3.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(speed, 6).alias("speed"), F.round(stress, 12).alias("stress"))


@query(f"""WITH {SIGNAL}, c AS (SELECT d, fmod(((d - DATE '2000-01-06') / 29.530588853::DOUBLE), 1.0) AS r FROM signal), p AS (SELECT d, CASE WHEN r < 0 THEN r + 1 ELSE r END AS cyc FROM c)
SELECT d, CASE floor(fmod(cyc + 0.125, 1.0) * 4)::INT WHEN 0 THEN 'new' WHEN 1 THEN 'first_quarter' WHEN 2 THEN 'full' ELSE 'last_quarter' END AS moon,
CASE WHEN month(d) IN (12, 1, 2) THEN 'DJF' WHEN month(d) IN (3, 4, 5) THEN 'MAM' WHEN month(d) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, ((year(d) - 1995) * 12 + month(d) - 1)::INT AS month_no FROM p""")
def calendar_labels(spark, sf_dir):
    rows = signal_daily(spark, sf_dir)
    return rows.select("d", cal.lunar_phase(F.col("d")).alias("moon"), cal.season("d").alias("season"), cal.month_distance(F.lit("1995-01-01").cast("date"), F.col("d")).alias("month_no"))
