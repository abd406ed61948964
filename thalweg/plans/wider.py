"""Registered queries: transformers with an inverse, conditions, contracts, scans by phase, event regressions, roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import climatology as clim
from ..operators import selection, stats, transformers
from ..sources.views import CUBE, PROFILES, SIGNAL, cube_daily, profiles, signal_daily, table
from .analysis import LAGGED, lagged_pairs
from .series import BASE, CUBE_WEEKLY, EVENTS, ONI, PHASES, WEEKLY, cube_weekly, events, oni, phase_table, rounded, weekly_signal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def least_squares(source: str, y: str, columns: list[str], keys: list[str], train: str) -> str:
    """CTEs after which ``fit`` holds the source's rows with ``fitted``: columns made orthogonal one by one over the training rows."""
    over = f"OVER (PARTITION BY {', '.join(keys)})" if keys else "OVER ()"
    ctes = [f"q_0 AS (SELECT *, 1.0::DOUBLE AS q0 FROM {source})"]
    for i, c in enumerate(columns, 1):
        less = "".join(f" - coalesce(sum({c} * q{j}) FILTER ({train}) {over} / nullif(sum(q{j} * q{j}) FILTER ({train}) {over}, 0), 0) * q{j}" for j in range(i))
        ctes.append(f"q_{i} AS (SELECT *, ({c}){less} AS q{i} FROM q_{i - 1})")
    fitted = " + ".join(f"sum({y} * q{j}) FILTER ({train}) {over} / sum(q{j} * q{j}) FILTER ({train}) {over} * q{j}" for j in range(len(columns) + 1))
    ctes.append(f"fit AS (SELECT *, {fitted} AS fitted FROM q_{len(columns)})")
    return ", ".join(ctes)


def fourier(day: str, harmonics: int, trend: bool) -> list[str]:
    out = [f"{f}({k} * 2 * pi() * (dayofyear({day}) - 1) / 365.2425)" for k in range(1, harmonics + 1) for f in ("sin", "cos")]
    return out + ([f"(({day} - DATE '2000-01-01') / 365.2425::DOUBLE)"] if trend else [])


# ---- transformers

_CELLS = least_squares("cw", "v", fourier("week_end", 1, True), ["pixel_id"], "WHERE year(week_end) <= 1998")


@query(f"""WITH {CUBE_WEEKLY}, {_CELLS}, s AS (SELECT *, sqrt(sum((v - fitted) * (v - fitted)) FILTER (year(week_end) <= 1998) OVER p / count(*) FILTER (year(week_end) <= 1998) OVER p) AS sd FROM fit WINDOW p AS (PARTITION BY pixel_id))
SELECT pixel_id, week_end, round(fitted, 4) AS fitted, round((v - fitted) / sd, 4) AS anomaly, round(v, 4) AS restored FROM s""")
def harmonic_transformer(spark, sf_dir):
    """Each cell's cycle and trend, fitted on training weeks, taken from all weeks, and put back."""
    rows = cube_weekly(spark, sf_dir)
    model = transformers.fit_harmonic(rows, F.year("week_end") <= 1998, ["pixel_id"], "week_end", "v", harmonics=1)
    out = model.inverse(model.transform(rows))
    return rounded(out.select("pixel_id", "week_end", "fitted", "anomaly", "restored"), 4)


_SOURCES = least_squares("r", "x", fourier("d", 1, True), ["source"], "WHERE year(d) <= 1999")


@query(f"""WITH {SIGNAL}, r AS (SELECT d, x / 1000 AS x, CASE WHEN month(d) % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM signal), {_SOURCES},
s AS (SELECT *, sqrt(sum((x - fitted) * (x - fitted)) FILTER (year(d) <= 1999) OVER p / count(*) FILTER (year(d) <= 1999) OVER p) AS sd FROM fit WINDOW p AS (PARTITION BY source))
SELECT d, source, round((x - fitted) / sd, 4) AS anomaly FROM s""")
def source_aware_preprocessor(spark, sf_dir):
    """Cycle and trend of each source on its own training rows."""
    rows = signal_daily(spark, sf_dir).select("d", (F.col("x") / 1000).alias("x"), F.when(F.month("d") % 2 == 0, "even").otherwise("odd").alias("source"))
    model = transformers.fit_harmonic(rows, F.year("d") <= 1999, ["source"], harmonics=1)
    return rounded(model.transform(rows).select("d", "source", "anomaly"), 4)


@query(f"""WITH {CUBE_WEEKLY}, tr AS (SELECT pixel_id, weekofyear(week_end) AS wk, v FROM cw WHERE week_end <= DATE '1999-12-31'), c AS (SELECT pixel_id, wk, median(v) AS m FROM tr GROUP BY ALL), p AS (SELECT pixel_id, median(v) AS pm FROM tr GROUP BY 1),
s AS (SELECT tr.pixel_id, median(abs(tr.v - c.m)) * 1.4826 AS sc FROM tr JOIN c USING (pixel_id, wk) GROUP BY 1)
SELECT cw.pixel_id, week_end, round((cw.v - coalesce(m, pm)) / greatest(sc, 0.1), 6) AS z, round(greatest(cw.v, 0), 6) AS restored FROM cw LEFT JOIN c ON c.pixel_id = cw.pixel_id AND c.wk = weekofyear(week_end) JOIN p ON p.pixel_id = cw.pixel_id JOIN s ON s.pixel_id = cw.pixel_id""")
def target_inverse(spark, sf_dir):
    """Scores of a target by training statistics, and the values that they stand for."""
    rows = cube_weekly(spark, sf_dir)
    model = transformers.fit_seasonal(rows, F.col("week_end") <= F.lit("1999-12-31").cast("date"), ["pixel_id"], "week_end", "v")
    return rounded(model.inverse(model.transform(rows)).select("pixel_id", "week_end", "z", "restored"))


@query(f"""WITH {WEEKLY}, b AS (SELECT weekofyear(week_end) AS wk, avg(x) AS m FROM weekly WHERE week_end BETWEEN DATE '{BASE[0]}' AND DATE '{BASE[1]}' GROUP BY 1),
s AS (SELECT (wk + o - 1 + 53) % 53 + 1 AS wk, avg(m) AS clim FROM b, (VALUES (-2), (-1), (0), (1), (2)) t(o) GROUP BY 1)
SELECT week_end, round(x - clim, 4) AS anomaly FROM weekly JOIN s ON s.wk = weekofyear(week_end)""")
def weekly_iso_anomaly(spark, sf_dir):
    """Weekly values less the mean of their ISO week over the base, smoothed over five weeks on a circle of 53."""
    return rounded(clim.iso_week_anomaly(weekly_signal(spark, sf_dir), value="x", base=BASE, width=5).select("week_end", "anomaly"), 4)


_DAILY = least_squares("signal", "x", fourier("d", 3, False), [], f"WHERE d BETWEEN DATE '{BASE[0]}' AND DATE '{BASE[1]}'")
#: SQL of ``harmonic_anomaly`` of series.py.
SQL["harmonic_anomaly"] = f"WITH {SIGNAL}, {_DAILY} SELECT d, round(fitted, 4) AS fitted, round(x - fitted, 4) AS anomaly FROM fit"


# ---- contracts and conditions


@query(f"""WITH {PHASES} SELECT week_end, event_type = 'warm' AS warm, event_type = 'cold' AND phase = 'peak' AS cold_peak, event_type = 'neutral' AS neutral, true AS every FROM phases""")
def condition_masks(spark, sf_dir):
    named = {"warm": "warm", "cold_peak": "cold:peak", "neutral": "neutral", "every": "all"}
    return phase_table(spark, sf_dir).select("week_end", *[selection.condition_mask(c).alias(n) for n, c in named.items()])


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_quantity FROM lineitem")
def physical_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", *selection.numeric_contract(rows, ["l_discount", "l_tax", "l_quantity"]))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def without_target_aliases(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*selection.without_aliases(rows.columns, "l_quantity", ("extendedprice", "quantity")))


_GROUPS = {"who": ("custkey", "clerk"), "when": ("orderdate",), "how": ("orderstatus", "orderpriority")}


@query("""SELECT column_name AS variable, CASE WHEN column_name = 'o_custkey' THEN 'who' WHEN column_name = 'o_orderdate' THEN 'when' WHEN column_name IN ('o_orderstatus', 'o_orderpriority') THEN 'how' ELSE 'other' END AS family
FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) t(column_name)""")
def feature_groups(spark, sf_dir):
    """Group and family of every column of a table by the parts of its name."""
    names = spark.createDataFrame([(c,) for c in table(spark, sf_dir, "orders").columns], "variable string")
    return names.withColumn("family", selection.column_group(F.col("variable"), _GROUPS))


@query(f"""WITH {CUBE} SELECT d, pixel_id, v, n_regionkey / 4.0::DOUBLE AS fraction, n_regionkey / 4.0::DOUBLE >= 0.5 AS inside FROM cube LEFT JOIN nation ON n_nationkey = pixel_id AND n_regionkey > 0""")
def pixel_mask(spark, sf_dir):
    """The share of each cell inside a territory, attached; cells outside it stay, with nulls."""
    cells = table(spark, sf_dir, "nation").where("n_regionkey > 0").select(F.col("n_nationkey").alias("pixel_id"), (F.col("n_regionkey") / 4.0).alias("fraction"))
    return cube_daily(spark, sf_dir).select("d", "pixel_id", "v").join(cells, "pixel_id", "left").withColumn("inside", F.col("fraction") >= 0.5)


@query(f"WITH {CUBE} SELECT d, pixel_id, v, v * 2 AS w FROM cube")
def aligned_fields(spark, sf_dir):
    rows = cube_daily(spark, sf_dir)
    return selection.aligned(rows, rows.select("d", "pixel_id", (F.col("v") * 2).alias("w")), ["d", "pixel_id"], "v", "w")


@query("SELECT o_orderkey, year(o_orderdate) AS y, o_totalprice FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997")
def concatenated_years(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), "o_totalprice")
    return selection.concatenated([rows.where(F.col("y") == y) for y in (1995, 1996, 1997)], ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey) LIMIT 200")
def hashed_sample(spark, sf_dir):
    return selection.hashed_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 200)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS run, max(ts) AS finished FROM events WHERE value > 0 AND props IS NOT NULL GROUP BY 1")
def latest_valid_run(spark, sf_dir):
    """Of each task the valid run that finished last."""
    rows = table(spark, sf_dir, "events").where((F.col("value") > 0) & F.col("props").isNotNull())
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("run"), F.max("ts").alias("finished"))


_EDGES = [("a", 130.0, -9.0), ("a", 300.0, -4.0), ("a", 200.0, 9.0), ("b", 10.0, -11.0), ("b", 120.0, -11.0), ("b", 120.0, 6.0), ("b", 60.0, -2.0), ("b", 10.0, 6.0)]


def _edges() -> list[tuple]:
    out = []
    for unit in ("a", "b"):
        at = [p[1:] for p in _EDGES if p[0] == unit]
        out += [(unit, *at[i], *at[(i + 1) % len(at)]) for i in range(len(at))]
    return out


@query(f"""WITH c AS (SELECT n_nationkey AS pixel_id, n_regionkey * 5.0::DOUBLE - 10.0 AS lat, n_nationkey * 14.4::DOUBLE AS lon FROM nation), e(unit, x1, y1, x2, y2) AS (VALUES {', '.join(f"('{e[0]}', {e[1]}::DOUBLE, {e[2]}::DOUBLE, {e[3]}::DOUBLE, {e[4]}::DOUBLE)" for e in _edges())})
SELECT pixel_id, unit FROM c, e WHERE least(y1, y2) <= lat AND lat < greatest(y1, y2) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1""")
def polygon_membership(spark, sf_dir):
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pixel_id"), (F.col("n_regionkey") * 5.0 - 10.0).alias("lat"), (F.col("n_nationkey") * 14.4).alias("lon"))
    edges = spark.createDataFrame(_edges(), "unit string, x1 double, y1 double, x2 double, y2 double")
    return selection.in_polygon(cells, edges, "lon", "lat", ["pixel_id"])


# ---- scalars


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 3600.0, 9) AS watts, round((0 - l_tax) / 3600.0, 9) AS flux, round(l_discount * 1000 * day(last_day(CAST(l_shipdate AS DATE))), 6) AS mm_month FROM lineitem")
def unit_conversions(spark, sf_dir):
    """Energy of an hour to a flux, an upward flux to a downward one, metres a day to millimetres a month."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / 3600.0, 9).alias("watts"), F.round((0 - F.col("l_tax")) / 3600.0, 9).alias("flux"), F.round(F.col("l_discount") * 1000 * F.day(F.last_day("l_shipdate")), 6).alias("mm_month"))


@query("SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS clipped, abs(c_acctbal / 10000 - 0.5) <= 0.1 AS within FROM customer")
def support_clip(spark, sf_dir):
    """Values kept in their physical support, and whether a rate is within a tolerance, ends included."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.least(F.greatest(F.col("c_acctbal"), F.lit(0.0)), F.lit(5000.0)).alias("clipped"), (F.abs(F.col("c_acctbal") / 10000 - 0.5) <= 0.1).alias("within"))


# ---- aggregates


@query(f"""WITH {EVENTS}, f AS (SELECT CAST(date_trunc('month', d) AS DATE) AS month, avg(v) AS mean, quantile_cont(v, 0.9) AS p90, count(*) AS n FROM (WITH {CUBE} SELECT d, v FROM cube) GROUP BY 1)
SELECT event_id, count(*) AS months, round(avg(mean), 6) AS mean, round(max(p90), 6) AS p90, sum(n)::BIGINT AS n FROM events_t JOIN f ON f.month BETWEEN onset AND "end" GROUP BY 1""")
def event_field_table(spark, sf_dir):
    """Monthly statistics of the field over the months of each event."""
    monthly = cube_daily(spark, sf_dir).groupBy(F.trunc("d", "month").alias("month")).agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.9)).alias("p90"), F.count("*").alias("n"))
    e = events(spark, sf_dir).withColumn("month", F.explode(F.sequence("onset", "end", F.expr("INTERVAL 1 MONTH"))))
    return rounded(e.join(monthly, "month").groupBy("event_id").agg(F.count("*").alias("months"), F.avg("mean").alias("mean"), F.max("p90").alias("p90"), F.sum("n").alias("n")))


@query(f"""WITH {CUBE}, e AS (SELECT *, v >= 60 AS extreme FROM cube) SELECT pixel_id, mode(region) AS region, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(avg(extreme::INT), 6) AS frequency FROM e GROUP BY 1""")
def cell_profile(spark, sf_dir):
    """Mean, deviation, frequency of extremes and commonest region of each cell."""
    return rounded(cube_daily(spark, sf_dir).groupBy("pixel_id").agg(F.mode("region").alias("region"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.avg((F.col("v") >= 60).cast("int")).alias("frequency")))


@query(f"""WITH {CUBE}, u AS (SELECT d, region, sum(v * cos(radians(lat))) / sum(cos(radians(lat))) AS value, count(*) / 5.0::DOUBLE AS coverage FROM cube GROUP BY ALL)
SELECT d, region, 'value' AS name, round(value, 6) AS x FROM u UNION ALL SELECT d, region, 'coverage', round(coverage, 6) FROM u""")
def regional_series(spark, sf_dir):
    """Area-weighted series of each region and the share of its cells with values, in long form."""
    w = F.cos(F.radians("lat"))
    u = cube_daily(spark, sf_dir).groupBy("d", "region").agg((F.sum(F.col("v") * w) / F.sum(w)).alias("value"), (F.count("*") / 5.0).alias("coverage"))
    return rounded(u.unpivot(["d", "region"], ["value", "coverage"], "name", "x"))


@query(f"""WITH {PROFILES}, g AS (SELECT *, (t - lag(t) OVER w) / (depth_m - lag(depth_m) OVER w) AS slope FROM profiles WINDOW w AS (PARTITION BY profile_id ORDER BY depth_m))
SELECT profile_id, count(*) AS levels, max(depth_m) AS deepest, round(avg(t) FILTER (depth_m <= 30), 6) AS upper, round(avg(t) FILTER (depth_m > 30), 6) AS lower, round(max(abs(slope)), 6) AS steepest FROM g GROUP BY 1""")
def profile_features(spark, sf_dir):
    """Features of each profile: levels, upper and lower means, steepest gradient."""
    w = Window.partitionBy("profile_id").orderBy("depth_m")
    rows = profiles(spark, sf_dir).withColumn("slope", (F.col("t") - F.lag("t").over(w)) / (F.col("depth_m") - F.lag("depth_m").over(w)))
    return rounded(rows.groupBy("profile_id").agg(F.count("*").alias("levels"), F.max("depth_m").alias("deepest"), F.avg(F.when(F.col("depth_m") <= 30, F.col("t"))).alias("upper"), F.avg(F.when(F.col("depth_m") > 30, F.col("t"))).alias("lower"), F.max(F.abs("slope")).alias("steepest")))


@query(f"""WITH {CUBE}, l AS (SELECT d + (7 - isodow(d))::INT AS week_end, avg(v) AS v FROM cube WHERE lon BETWEEN 150 AND 250 GROUP BY 1), p AS (SELECT *, v > lag(v) OVER w AND v >= lead(v) OVER w AND v > avg(v) OVER () + stddev_pop(v) OVER () AS pulse, avg(v) OVER (ORDER BY week_end ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS after FROM l WINDOW w AS (ORDER BY week_end))
SELECT week_end, round(v, 6) AS amplitude, round(after, 6) AS after_6w FROM p WHERE pulse""")
def pulses(spark, sf_dir):
    """Weekly peaks of a box mean over one deviation, with the mean of the six weeks after."""
    rows = cube_daily(spark, sf_dir).where("lon BETWEEN 150 AND 250").groupBy(F.date_add("d", F.pmod(8 - F.dayofweek("d"), F.lit(7))).alias("week_end")).agg(F.avg("v").alias("v"))
    w, every = Window.orderBy("week_end"), Window.partitionBy()
    peak = (F.col("v") > F.lag("v").over(w)) & (F.col("v") >= F.lead("v").over(w)) & (F.col("v") > F.avg("v").over(every) + F.stddev_pop("v").over(every))
    rows = rows.withColumn("pulse", peak).withColumn("after", F.avg("v").over(w.rowsBetween(1, 6))).where("pulse")
    return rounded(rows.select("week_end", F.col("v").alias("amplitude"), F.col("after").alias("after_6w")))


# ---- statistics

_SCAN = f"""{LAGGED}, ph AS (SELECT * FROM (WITH {PHASES} SELECT week_end, event_type, phase, coalesce(event_id, 'none') AS event_id FROM phases)), c AS (SELECT p.*, event_type, phase, event_id FROM pairs p JOIN ph USING (week_end)),
a AS (SELECT *, lag(x) OVER w AS px, lag(v) OVER w AS pv, week_end - lag(week_end) OVER w AS gap FROM c WINDOW w AS (PARTITION BY pixel_id, lag, event_type, phase, event_id ORDER BY week_end)),
g AS (SELECT pixel_id, lag, event_type, phase, count(*) AS n, count(DISTINCT event_id) AS n_events, corr(x, v) AS r, corr(x, px) FILTER (gap = 7) AS cx, corr(v, pv) FILTER (gap = 7) AS cv, CASE WHEN isfinite(cx) THEN cx ELSE 0 END AS ax, CASE WHEN isfinite(cv) THEN cv ELSE 0 END AS av FROM a GROUP BY ALL)"""


@query(f"""WITH {_SCAN} SELECT pixel_id, lag, event_type, phase, n, n_events, round(CASE WHEN n >= 10 THEN r END, 6) AS r, round(greatest(3, least(n, n * (1 - b) / (1 + b))), 4) AS n_eff FROM (SELECT *, greatest(-0.99::DOUBLE, least(0.99::DOUBLE, ax * av)) AS b FROM g)""")
def conditioned_scan(spark, sf_dir):
    """Correlation of every cell, lag and phase at the source's time, with the effective size from steps inside events."""
    rows = lagged_pairs(spark, sf_dir).join(phase_table(spark, sf_dir).select("week_end", "event_type", "phase", F.coalesce("event_id", F.lit("none")).alias("event_id")), "week_end")
    out = stats.conditioned_correlations(rows, ["pixel_id", "lag", "event_type", "phase"], "event_id", "week_end", "x", "v", step_days=7, least=10)
    return out.withColumn("r", F.round("r", 6)).withColumn("n_eff", F.round("n_eff", 4))


@query(f"""WITH {_SCAN}, b AS (SELECT *, row_number() OVER (PARTITION BY pixel_id, event_type, phase ORDER BY round(abs(r), 9) DESC, lag) AS k FROM g WHERE n >= 10 AND r IS NOT NULL AND NOT isnan(r))
SELECT pixel_id, event_type, phase, lag, round(r, 6) AS r FROM b WHERE k = 1""")
def conditioned_best_lag(spark, sf_dir):
    """Of each cell and phase the lag of the strongest correlation, the shortest of equal ones."""
    rows = lagged_pairs(spark, sf_dir).join(phase_table(spark, sf_dir).select("week_end", "event_type", "phase", F.coalesce("event_id", F.lit("none")).alias("event_id")), "week_end")
    out = stats.conditioned_correlations(rows, ["pixel_id", "lag", "event_type", "phase"], "event_id", "week_end", "x", "v", step_days=7, least=10)
    w = Window.partitionBy("pixel_id", "event_type", "phase").orderBy(F.desc(F.round(F.abs("r"), 9)), "lag")
    out = out.where("r is not null").withColumn("k", F.row_number().over(w)).where("k = 1")
    return rounded(out.select("pixel_id", "event_type", "phase", "lag", "r"))


@query(f"""WITH {LAGGED}, c AS (SELECT pixel_id, count(*) AS n, corr(x, v) AS xy, corr(x, month(week_end)) AS xa, corr(v, month(week_end)) AS ya, corr(x, year(week_end)) AS xb, corr(v, year(week_end)) AS yb, corr(month(week_end), year(week_end)) AS ab FROM pairs WHERE lag = 0 GROUP BY 1),
p AS (SELECT pixel_id, n, (xy - xa * ya) / sqrt((1 - xa * xa) * (1 - ya * ya)) AS r, (xb - xa * ab) / sqrt((1 - xa * xa) * (1 - ab * ab)) AS rx, (yb - ya * ab) / sqrt((1 - ya * ya) * (1 - ab * ab)) AS ry FROM c)
SELECT pixel_id, n, round((r - rx * ry) / sqrt((1 - rx * rx) * (1 - ry * ry)), 6) AS r FROM p""")
def partial_correlation_two(spark, sf_dir):
    """Correlation of what a linear fit on two controls leaves of both."""
    rows = lagged_pairs(spark, sf_dir).where("lag = 0").withColumn("a", F.month("week_end").cast("double")).withColumn("b", F.year("week_end").cast("double"))
    return rounded(stats.partial_correlation_of(rows, ["pixel_id"], "x", "v", ["a", "b"]))


_VIF = least_squares("z1", "x1", ["x2", "x3"], ["pixel_id"], "WHERE true")


@query(f"""WITH {CUBE_WEEKLY}, z AS (SELECT pixel_id, lag(v, 1) OVER w AS x1, lag(v, 2) OVER w AS x2, lag(v, 3) OVER w AS x3 FROM cw WINDOW w AS (PARTITION BY pixel_id ORDER BY week_end)), z1 AS (SELECT * FROM z WHERE x3 IS NOT NULL), {_VIF}
SELECT pixel_id, 'x1' AS variable, round(1 / (sum((x1 - fitted) ** 2) / (var_pop(x1) * count(*))), 6) AS vif FROM fit GROUP BY 1""")
def variance_inflation(spark, sf_dir):
    """Variance inflation of the first of three lagged predictors in each cell."""
    w = Window.partitionBy("pixel_id").orderBy("week_end")
    rows = cube_weekly(spark, sf_dir).select("pixel_id", *[F.lag("v", k).over(w).alias(f"x{k}") for k in (1, 2, 3)]).where("x3 is not null")
    return rounded(stats.variance_inflation(rows, ["pixel_id"], ["x1", "x2", "x3"]).where("variable = 'x1'"))


@query("""WITH RECURSIVE m AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_quantity * l_discount AS rebate FROM lineitem), names AS (SELECT unnest(['quantity', 'price', 'discount', 'tax', 'rebate']) AS a),
c AS (SELECT corr(quantity, price) AS c1, corr(quantity, discount) AS c2, corr(quantity, tax) AS c3, corr(quantity, rebate) AS c4, corr(price, discount) AS c5, corr(price, tax) AS c6, corr(price, rebate) AS c7, corr(discount, tax) AS c8, corr(discount, rebate) AS c9, corr(tax, rebate) AS c10 FROM m),
e AS (SELECT t.a, t.b FROM c, LATERAL (VALUES ('quantity', 'price', c1), ('quantity', 'discount', c2), ('quantity', 'tax', c3), ('quantity', 'rebate', c4), ('price', 'discount', c5), ('price', 'tax', c6), ('price', 'rebate', c7), ('discount', 'tax', c8), ('discount', 'rebate', c9), ('tax', 'rebate', c10)) t(a, b, r) WHERE abs(r) >= 0.6),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(a, b) AS (SELECT a, a FROM names UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b) SELECT a AS variable, min(b) AS component FROM r GROUP BY 1""")
def correlation_components(spark, sf_dir):
    """Variables linked by correlations of 0.6 or more, by the first name of their component."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_quantity") * F.col("l_discount")).alias("rebate"))
    found = stats.correlation_components(rows, rows.columns, 0.6)
    return spark.createDataFrame(sorted(found.items()), "variable string, component string")


# ---- supervised tables and models


@query(f"""WITH {EVENTS}, o AS (SELECT month, oni, avg(oni) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h3, avg(oni) OVER (ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS h6 FROM oni WHERE oni IS NOT NULL)
SELECT event_id, lead::INT AS lead, round(oni, 6) AS oni, round(h3, 6) AS h3, round(h6, 6) AS h6, round(peak_value, 6) AS target FROM events_t, (VALUES (1), (3), (6), (9), (12)) t(lead) JOIN o ON o.month = peak_time - to_months(lead::INT)""")
def progression_table(spark, sf_dir):
    """Features of the months before each event's peak, and the peak as target."""
    w = Window.orderBy("month")
    o = oni(spark, sf_dir).where("oni is not null").select("month", "oni", F.avg("oni").over(w.rowsBetween(-2, 0)).alias("h3"), F.avg("oni").over(w.rowsBetween(-5, 0)).alias("h6"))
    e = events(spark, sf_dir).select("event_id", "peak_time", F.col("peak_value").alias("target"), F.explode(F.array(*map(F.lit, (1, 3, 6, 9, 12)))).alias("lead"))
    return rounded(e.withColumn("month", F.add_months("peak_time", -F.col("lead"))).join(o, "month").select("event_id", "lead", "oni", "h3", "h6", "target"))


@query(f"""WITH {PHASES}, b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY week_end) AS k FROM phases WHERE event_id IS NOT NULL)
SELECT event_id, event_type, phase, week_end AS origin, 'event' AS kind FROM b WHERE k = 1 UNION ALL SELECT event_id, event_type, phase, min(week_end), 'phase' FROM phases WHERE event_id IS NOT NULL GROUP BY ALL""")
def origin_rows(spark, sf_dir):
    """The week in which each event, and each of its phases, is first seen."""
    rows = phase_table(spark, sf_dir).where("event_id is not null")
    first = rows.groupBy("event_id").agg(F.min(F.struct("week_end", "event_type", "phase")).alias("f")).select("event_id", "f.event_type", "f.phase", F.col("f.week_end").alias("origin"), F.lit("event").alias("kind"))
    return first.unionByName(rows.groupBy("event_id", "event_type", "phase").agg(F.min("week_end").alias("origin")).withColumn("kind", F.lit("phase")))


@query(f"""WITH {EVENTS}, n AS (SELECT *, row_number() OVER (ORDER BY onset) AS k FROM events_t), f AS (SELECT a.event_id, a.k, abs(a.peak_value) AS y, a.months AS x, regr_slope(abs(b.peak_value), b.months) AS slope, regr_intercept(abs(b.peak_value), b.months) AS base, avg(abs(b.peak_value)) AS mean, count(*) AS n FROM n a JOIN n b ON b.k < a.k GROUP BY ALL)
SELECT event_id, round(y, 6) AS y, round(coalesce(base + slope * x, mean), 6) AS p, n FROM f WHERE n >= 3""")
def event_dimension_regression(spark, sf_dir):
    """Peak size of each event predicted from its length by the events before it."""
    n = events(spark, sf_dir).select("event_id", F.abs("peak_value").alias("y"), F.col("months").cast("double").alias("x"), "onset")
    w = Window.orderBy("onset").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"n": F.count("y").over(w), "mean": F.avg("y").over(w), "mx": F.avg("x").over(w), "slope": F.regr_slope("y", "x").over(w)}
    p = F.coalesce(F.col("mean") + F.col("slope") * (F.col("x") - F.col("mx")), F.col("mean"))
    return rounded(n.withColumns(sums).where("n >= 3").select("event_id", "y", p.alias("p"), "n"))


@query(f"""WITH {LAGGED}, ph AS (SELECT * FROM (WITH {PHASES} SELECT week_end, event_type FROM phases)), c AS (SELECT pixel_id, event_type, lag, week_end, x, v FROM pairs JOIN ph USING (week_end) WHERE lag = 28),
m AS (SELECT pixel_id, event_type, regr_slope(v, x) AS slope, regr_intercept(v, x) AS base, avg(v) AS mean, count(*) AS n FROM c WHERE year(week_end) <= 1998 GROUP BY ALL HAVING count(*) >= 20),
t AS (SELECT c.pixel_id, c.event_type, v, base + slope * x AS p, mean FROM c JOIN m USING (pixel_id, event_type) WHERE year(week_end) > 1998)
SELECT pixel_id, event_type, count(*) AS n, round(sqrt(avg((v - p) ** 2)), 6) AS rmse, round(1 - sum((v - p) ** 2) / nullif(sum((v - mean) ** 2), 0), 6) AS skill FROM t GROUP BY ALL""")
def pixel_teleconnection(spark, sf_dir):
    """Each cell's regression on the signal four weeks before, by event type, on later years, against the training mean."""
    rows = lagged_pairs(spark, sf_dir).where("lag = 28").join(phase_table(spark, sf_dir).select("week_end", "event_type"), "week_end")
    fit = rows.where(F.year("week_end") <= 1998).groupBy("pixel_id", "event_type").agg(F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("base"), F.avg("v").alias("mean"), F.count("*").alias("k")).where("k >= 20")
    e, m = F.col("v") - F.col("base") - F.col("slope") * F.col("x"), F.col("v") - F.col("mean")
    out = rows.where(F.year("week_end") > 1998).join(fit, ["pixel_id", "event_type"]).groupBy("pixel_id", "event_type")
    return rounded(out.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.nullif(F.sum(m * m), F.lit(0.0)))).alias("skill")))


@query(f"""WITH {WEEKLY}, ph AS (SELECT * FROM (WITH {PHASES} SELECT week_end, CASE WHEN event_type = 'neutral' THEN 'neutral' ELSE event_type || '_' || phase END AS state FROM phases)), f AS (SELECT week_end, x / 1000 AS x1, lag(x, 4) OVER w / 1000 AS x2 FROM weekly WINDOW w AS (ORDER BY week_end)), r AS (SELECT f.*, state FROM f JOIN ph USING (week_end) WHERE x2 IS NOT NULL),
m AS (SELECT state, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) + 1e-3 AS v1, var_pop(x2) + 1e-3 AS v2 FROM r WHERE year(week_end) <= 1998 GROUP BY 1), s AS (SELECT week_end, r.state, m.state AS p, ln(n) - 0.5 * (ln(v1) + ln(v2) + (x1 - m1) ** 2 / v1 + (x2 - m2) ** 2 / v2) AS score FROM r, m WHERE year(week_end) > 1998)
SELECT week_end, any_value(state) AS state, arg_max(p, (round(score, 9), p)) AS predicted FROM s GROUP BY 1""")
def state_classifier(spark, sf_dir):
    """The life-cycle states of later years by a Gaussian Bayes model of the training years."""
    from ..operators.classifiers import gaussian_bayes

    f = weekly_signal(spark, sf_dir).select("week_end", (F.col("x") / 1000).alias("x1"), (F.lag("x", 4).over(Window.orderBy("week_end")) / 1000).alias("x2"))
    state = F.when(F.col("event_type") == "neutral", "neutral").otherwise(F.concat_ws("_", "event_type", "phase"))
    rows = f.join(phase_table(spark, sf_dir).select("week_end", state.alias("state")), "week_end").where("x2 is not null")
    return gaussian_bayes(rows.where(F.year("week_end") <= 1998), rows.where(F.year("week_end") > 1998), ["week_end"], "state", ["x1", "x2"])


@query(f"""WITH {LAGGED}, p AS (SELECT pixel_id, week_end, x, v, row_number() OVER (PARTITION BY pixel_id ORDER BY md5(week_end::VARCHAR)) AS k, row_number() OVER (PARTITION BY pixel_id ORDER BY week_end) AS i FROM pairs WHERE lag = 0),
m AS (SELECT pixel_id, regr_slope(v, x) AS s, regr_intercept(v, x) AS b FROM p GROUP BY 1) SELECT a.pixel_id, 'x' AS feature, round(avg((a.v - b - s * c.x) ** 2) - avg((a.v - b - s * a.x) ** 2), 6) AS importance FROM p a JOIN p c ON c.pixel_id = a.pixel_id AND c.k = a.i JOIN m ON m.pixel_id = a.pixel_id GROUP BY ALL""")
def permutation_importance(spark, sf_dir):
    """How much worse each cell's regression gets when its predictor is shuffled; the order is a hash, the same each time."""
    rows = lagged_pairs(spark, sf_dir).where("lag = 0").select("pixel_id", "week_end", "x", "v")
    return rounded(stats.permutation_importance(rows, ["pixel_id"], "week_end", "x", "v"))


@query(f"""WITH {CUBE_WEEKLY}, p AS (SELECT pixel_id, year(week_end)::INT AS fold, v, lag(v, 1) OVER w AS a, lag(v, 4) OVER w AS b FROM cw WINDOW w AS (PARTITION BY pixel_id ORDER BY week_end)), e AS (SELECT pixel_id, fold, sqrt(avg((v - a) ** 2)) AS rmse, avg(abs(v - a)) AS mae FROM p WHERE a IS NOT NULL GROUP BY ALL), l AS (SELECT pixel_id, 'rmse' AS metric, rmse AS x FROM e UNION ALL SELECT pixel_id, 'mae', mae FROM e)
SELECT pixel_id, metric, count(*) AS folds, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS low, round(max(x), 6) AS high FROM l GROUP BY ALL""")
def metrics_summary(spark, sf_dir):
    """Mean and spread over folds of each metric of a persistence forecast, a cell."""
    w = Window.partitionBy("pixel_id").orderBy("week_end")
    rows = cube_weekly(spark, sf_dir).withColumn("fold", F.year("week_end")).withColumn("e", F.col("v") - F.lag("v").over(w)).where("e is not null")
    each = rows.groupBy("pixel_id", "fold").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"))
    long = each.unpivot(["pixel_id", "fold"], ["rmse", "mae"], "metric", "x")
    return rounded(long.groupBy("pixel_id", "metric").agg(F.count("*").alias("folds"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high")))


@query(f"""WITH {CUBE_WEEKLY}, p AS (SELECT pixel_id, year(week_end)::INT AS fold, v, lag(v, 1) OVER w AS a, avg(v) OVER (PARTITION BY pixel_id ORDER BY week_end ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b FROM cw WINDOW w AS (PARTITION BY pixel_id ORDER BY week_end)), e AS (SELECT pixel_id, fold, sqrt(avg((v - a) ** 2)) AS x, sqrt(avg((v - b) ** 2)) AS y FROM p WHERE a IS NOT NULL GROUP BY ALL)
SELECT fold, count(*) AS cells, count(*) FILTER (y < x) AS better, round(avg(y - x), 6) AS delta FROM e GROUP BY 1""")
def ablation_comparison(spark, sf_dir):
    """Two runs on the same folds and cells: how many cells the second is better on, and by how much."""
    w = Window.partitionBy("pixel_id").orderBy("week_end")
    rows = cube_weekly(spark, sf_dir).withColumn("fold", F.year("week_end")).withColumn("a", F.lag("v").over(w)).withColumn("b", F.avg("v").over(w.rowsBetween(-4, -1))).where("a is not null")
    e = rows.groupBy("pixel_id", "fold").agg(F.sqrt(F.avg((F.col("v") - F.col("a")) ** 2)).alias("x"), F.sqrt(F.avg((F.col("v") - F.col("b")) ** 2)).alias("y"))
    return rounded(e.groupBy("fold").agg(F.count("*").alias("cells"), F.count_if(F.col("y") < F.col("x")).alias("better"), F.avg(F.col("y") - F.col("x")).alias("delta")))


@query(f"""WITH {CUBE_WEEKLY}, r AS (SELECT pixel_id, week_end, v, row_number() OVER (PARTITION BY pixel_id ORDER BY md5(week_end::VARCHAR)) AS k, row_number() OVER (PARTITION BY pixel_id ORDER BY week_end) AS i, (('0x' || substr(md5('42|' || week_end::VARCHAR), 1, 4))::BIGINT % 101) / 100.0::DOUBLE AS w FROM cw WHERE year(week_end) <= 1996)
SELECT a.pixel_id, a.week_end, round(a.w * a.v + (1 - a.w) * b.v, 6) AS v, true AS is_synthetic FROM r a JOIN r b ON b.pixel_id = a.pixel_id AND b.k = a.i""")
def mixup_rows(spark, sf_dir):
    """Convex mixtures of pairs of training rows of a cell; partners and weights are hashes, the same each time."""
    by = Window.partitionBy("pixel_id")
    stamp = F.col("week_end").cast("string")
    rows = cube_weekly(spark, sf_dir).where(F.year("week_end") <= 1996).withColumn("k", F.row_number().over(by.orderBy(F.md5(stamp)))).withColumn("i", F.row_number().over(by.orderBy("week_end")))
    w = F.conv(F.substring(F.md5(F.concat(F.lit("42|"), stamp)), 1, 4), 16, 10).cast("long") % 101 / 100.0
    other = rows.select("pixel_id", F.col("k").alias("i"), F.col("v").alias("other"))
    return rounded(rows.join(other, ["pixel_id", "i"]).select("pixel_id", "week_end", (w * F.col("v") + (1 - w) * F.col("other")).alias("v"), F.lit(True).alias("is_synthetic")))


# ---- audits


@query(f"""WITH {CUBE}, s AS (SELECT count(*) AS n, count(DISTINCT (d, pixel_id)) AS keys, count(v) AS valid, count(DISTINCT pixel_id) AS cells, min(v) AS low, max(v) AS high FROM cube)
SELECT 'keys_unique' AS "check", n = keys AS passed, (n - keys)::VARCHAR AS detail FROM s UNION ALL SELECT 'no_nulls', n = valid, (n - valid)::VARCHAR FROM s UNION ALL SELECT 'all_cells', cells = 25, cells::VARCHAR FROM s UNION ALL SELECT 'physical_range', low >= 0 AND high < 100000, (low >= 0)::VARCHAR FROM s""")
def native_validation(spark, sf_dir):
    """Checks of a gridded target in one pass."""
    one = cube_daily(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("d", "pixel_id").alias("keys"), F.count("v").alias("valid"), F.countDistinct("pixel_id").alias("cells"), F.min("v").alias("low"), F.max("v").alias("high"))
    row = lambda name, passed, detail: F.struct(F.lit(name).alias("check"), passed.alias("passed"), detail.cast("string").alias("detail"))
    n, k, v, c = (F.col(x) for x in ("n", "keys", "valid", "cells"))
    checks = [row("keys_unique", n == k, n - k), row("no_nulls", n == v, n - v), row("all_cells", c == 25, c), row("physical_range", (F.col("low") >= 0) & (F.col("high") < 100000), F.col("low") >= 0)]
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


@query(f"WITH {SIGNAL} SELECT year(d) AS y, month(d) AS m, count(*) AS present, day(last_day(min(d))) AS expected, count(*) = day(last_day(min(d))) AS complete FROM signal GROUP BY ALL")
def daily_store_audit(spark, sf_dir):
    """Days present and expected of every month."""
    expected = F.day(F.last_day(F.min("d"))).cast("long")
    return signal_daily(spark, sf_dir).groupBy(F.year("d").cast("long").alias("y"), F.month("d").cast("long").alias("m")).agg(F.count("*").alias("present"), expected.alias("expected"), (F.count("*") == expected).alias("complete"))


@query(f"""WITH {SIGNAL}, n AS (SELECT d, x, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM signal) SELECT d, x IS NULL OR x <= 0 AS empty FROM n WHERE i IN (SELECT DISTINCT floor(k * (n - 1) / 5)::BIGINT FROM n, range(6) t(k))""")
def sampled_empty_days(spark, sf_dir):
    """Six days spread over the axis, and whether they are empty."""
    w = Window.orderBy("d")
    rows = signal_daily(spark, sf_dir).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    at = F.array(*[F.floor(k * (F.col("n") - 1) / 5) for k in range(6)])
    return rows.where(F.array_contains(at, F.col("i").cast("long"))).select("d", (F.col("x").isNull() | (F.col("x") <= 0)).alias("empty"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value <= 0 OR value IS NULL) AS bad FROM events GROUP BY ALL)
SELECT user_id, count(*) AS kinds, CASE WHEN count(*) < 3 THEN 'missing' WHEN sum(bad) > 0 THEN 'failed' ELSE 'passed' END AS status FROM c GROUP BY 1""")
def status_rollup(spark, sf_dir):
    """The status of each task from its evidence; what is missing or bad closes it."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if((F.col("value") <= 0) | F.col("value").isNull()).alias("bad"))
    return c.groupBy("user_id").agg(F.count("*").alias("kinds"), F.when(F.count("*") < 3, "missing").when(F.sum("bad") > 0, "failed").otherwise("passed").alias("status"))


# ---- reduction and models of pyspark.ml: without SQL, tested against numpy


def week_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week_end, id, v): each week's field as a vector of all cells, 0 where a cell has no value."""
    cells = sorted(r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())
    wide = cube_weekly(spark, sf_dir).groupBy("week_end").pivot("pixel_id", cells).agg(F.max("v"))
    return wide.select("week_end", F.datediff("week_end", F.lit("1970-01-01")).cast("long").alias("id"), F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cells]).alias("v"))


@query()
def pca_stability(spark, sf_dir):
    """How alike the leading directions of the weekly field are when they are fitted up to the end of each year."""
    from ..operators.models import component_stability

    found = component_stability(week_vectors(spark, sf_dir), "id", "v", "week_end", [f"{y}-12-31" for y in range(1996, 2001)], 2)
    return rounded(spark.createDataFrame(found, "end string, component int, similarity double, stable boolean"), 4)


@query()
def eof_by_phase(spark, sf_dir):
    """Leading pattern's amplitude of each event in its growth phase: events by cells, means over the phase's weeks."""
    from ..operators.models import principal_components

    ph = phase_table(spark, sf_dir).where("phase = 'growth'").select("week_end", "event_id")
    cells = sorted(r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())
    wide = cube_weekly(spark, sf_dir).join(ph, "week_end").groupBy("event_id").pivot("pixel_id", cells).agg(F.avg("v"))
    rows = wide.select("event_id", F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cells]).alias("v"))
    return rounded(principal_components(rows, "event_id", "v", 1), 4)


@query()
def variable_clusters(spark, sf_dir):
    """Variables in clusters by average linkage of 1 less their absolute rank correlation."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    names = ["quantity", "price", "discount", "tax"]
    found = stats.average_linkage(stats.rank_distances(rows, names, "id"), names, 0.85)
    return spark.createDataFrame(sorted(found.items()), "variable string, cluster string")


@query()
def event_probability(spark, sf_dir):
    """Probability that a later week is in an event, by logistic regression on the signal and its past."""
    from ..operators.classifiers import classify

    w = Window.orderBy("week_end")
    f = weekly_signal(spark, sf_dir).select("week_end", (F.col("x") / 1000).alias("x0"), (F.lag("x", 4).over(w) / 1000).alias("x4"), (F.lag("x", 13).over(w) / 1000).alias("x13")).dropna()
    rows = f.join(phase_table(spark, sf_dir).select("week_end", (F.col("event_type") != "neutral").cast("int").alias("y")), "week_end")
    return rounded(classify(rows.where(F.year("week_end") <= 1998), rows.where(F.year("week_end") > 1998), ["week_end"], "y", ["x0", "x4", "x13"]), 4)
