"""Registered queries: fold-safe transformers, event catalogues, baselines, field significance, audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hash32
from ..operators import grid, inference, stats, vertical, windows
from ..sources.views import CUBE, cube_daily, table
from .analysis import LAGGED, lagged_pairs
from .series import CUBE_WEEKLY, EVENTS, ONI, PHASES, WEEKLY, cube_weekly, events, oni, phase_table, rounded, weekly_signal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {CUBE_WEEKLY}, tr AS (SELECT pixel_id, weekofyear(week_end) AS wk, v FROM cw WHERE week_end <= DATE '1999-12-31'), c AS (SELECT pixel_id, wk, median(v) AS m FROM tr GROUP BY ALL), p AS (SELECT pixel_id, median(v) AS pm FROM tr GROUP BY 1),
s AS (SELECT tr.pixel_id, median(abs(tr.v - c.m)) * 1.4826 AS sc FROM tr JOIN c USING (pixel_id, wk) GROUP BY 1)
SELECT cw.pixel_id, week_end, cw.v - coalesce(m, pm) AS anomaly, round((cw.v - coalesce(m, pm)) / greatest(sc, 0.1), 6) AS z FROM cw LEFT JOIN c ON c.pixel_id = cw.pixel_id AND c.wk = weekofyear(week_end) JOIN p ON p.pixel_id = cw.pixel_id JOIN s ON s.pixel_id = cw.pixel_id""")
def fold_transformer(spark, sf_dir):
    """Anomaly and robust score from statistics of the training rows only; an unseen week takes the pooled median."""
    rows = cube_weekly(spark, sf_dir).withColumn("wk", F.weekofyear("week_end"))
    train = rows.where(F.col("week_end") <= F.lit("1999-12-31").cast("date"))
    centre = train.groupBy("pixel_id", "wk").agg(F.median("v").alias("m"))
    pooled = train.groupBy("pixel_id").agg(F.median("v").alias("pm"))
    scale = train.join(centre, ["pixel_id", "wk"]).groupBy("pixel_id").agg((F.median(F.abs(F.col("v") - F.col("m"))) * 1.4826).alias("sc"))
    out = rows.join(centre, ["pixel_id", "wk"], "left").join(pooled, "pixel_id").join(scale, "pixel_id")
    anomaly = F.col("v") - F.coalesce("m", "pm")
    return out.select("pixel_id", "week_end", anomaly.alias("anomaly"), F.round(anomaly / F.greatest(F.col("sc"), F.lit(0.1)), 6).alias("z"))


@query(f"""WITH {WEEKLY}, a AS (SELECT week_end, x - avg(x) OVER () AS a, stddev_pop(x) OVER () AS sd FROM weekly), s AS (SELECT week_end, CASE WHEN count(a) OVER w >= 6 THEN avg(a / sd) OVER w END AS s FROM a WINDOW w AS (ORDER BY week_end ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
o AS (SELECT *, s >= 0.05 AS is_on FROM s WHERE s IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY week_end) - row_number() OVER (PARTITION BY is_on ORDER BY week_end) AS run FROM o)
SELECT min(week_end) AS start, max(week_end) AS "end", count(*) AS months, round(max(s), 6) AS top, CAST(row_number() OVER (ORDER BY min(week_end)) AS INT) AS run_no FROM r WHERE is_on GROUP BY run HAVING count(*) >= 5""")
def weekly_event_catalogue(spark, sf_dir):
    """Runs of the smoothed weekly signal over a threshold; "months" counts its weeks."""
    from ..operators.events import gap_tolerant_runs

    w = Window.partitionBy()
    rows = weekly_signal(spark, sf_dir).withColumn("a", (F.col("x") - F.avg("x").over(w)) / F.stddev_pop("x").over(w))
    rows = rows.select("week_end", windows.centred_mean("a", 13, 6, [], "week_end").alias("s"))
    return rounded(gap_tolerant_runs(rows, "s", "week_end", 0.05, 5))


@query(f"""WITH {ONI}, s AS (SELECT month, oni > 0.3 AS is_on, oni FROM oni WHERE oni IS NOT NULL), r AS (SELECT *, year(month) * 12 + month(month) - row_number() OVER (PARTITION BY is_on ORDER BY month) AS run FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY month) AS place, count(*) OVER (PARTITION BY run) AS size, first_value(month) OVER (PARTITION BY run ORDER BY oni DESC, month) AS top FROM r WHERE is_on)
SELECT month, size AS run_months, place, CASE WHEN month < top THEN 'onset' WHEN month = top THEN 'peak' ELSE 'decay' END AS label FROM p""")
def month_labels(spark, sf_dir):
    """Onset, peak and decay of each month of a run over a threshold."""
    rows = windows.islands(oni(spark, sf_dir).where("oni is not null").withColumn("is_on", F.col("oni") > 0.3), "is_on", [], "month", F.year("month") * 12 + F.month("month")).where("is_on")
    w = Window.partitionBy("run")
    top = F.first("month").over(w.orderBy(F.desc("oni"), "month"))
    return rows.select("month", F.count("*").over(w).alias("run_months"), F.row_number().over(w.orderBy("month")).cast("long").alias("place"), F.when(F.col("month") < top, "onset").when(F.col("month") == top, "peak").otherwise("decay").alias("label"))


@query(f"""WITH {EVENTS}, k AS (SELECT event_type, last_day("end") AS e, row_number() OVER (PARTITION BY event_type ORDER BY onset) AS k FROM events_t) SELECT max(e) + 5 * 7 AS start FROM k WHERE k = 1""")
def balanced_support_start(spark, sf_dir):
    """First day on which every type has had an event, and the purge is over."""
    k = F.row_number().over(Window.partitionBy("event_type").orderBy("onset"))
    return events(spark, sf_dir).withColumn("k", k).where("k = 1").agg(F.date_add(F.max(F.last_day("end")), 35).alias("start"))


@query(f"""WITH {PHASES}, s AS (SELECT week_end, weekofyear(week_end)::INT AS wk, phase, lag(phase, 4) OVER (ORDER BY week_end) AS persistence FROM phases), n AS (SELECT wk, phase, count(*) AS n FROM s WHERE year(week_end) <= 1999 GROUP BY ALL), m AS (SELECT wk, arg_min(phase, (-n, phase)) AS modal FROM n GROUP BY 1)
SELECT count(*) AS n, round(avg((phase = modal)::INT), 6) AS modal_accuracy, round(avg((phase = persistence)::INT), 6) AS persistence_accuracy FROM s JOIN m USING (wk) WHERE year(week_end) > 1999""")
def state_baselines(spark, sf_dir):
    """Accuracy of the training weeks' modal state and of the state four weeks before."""
    rows = phase_table(spark, sf_dir).select("week_end", F.weekofyear("week_end").alias("wk"), "phase", F.lag("phase", 4).over(Window.orderBy("week_end")).alias("persistence"))
    counts = rows.where(F.year("week_end") <= 1999).groupBy("wk", "phase").agg(F.count("*").alias("n"))
    modal = counts.groupBy("wk").agg(F.min_by("phase", F.struct(-F.col("n"), F.col("phase"))).alias("modal"))
    test = rows.where(F.year("week_end") > 1999).join(F.broadcast(modal), "wk")
    return rounded(test.agg(F.count("*").alias("n"), F.avg((F.col("phase") == F.col("modal")).cast("int")).alias("modal_accuracy"), F.avg((F.col("phase") == F.col("persistence")).cast("int")).alias("persistence_accuracy")))


@query(f"""WITH {LAGGED}, z AS (SELECT pixel_id, row_number() OVER (PARTITION BY pixel_id ORDER BY week_end) - 1 AS i, count(*) OVER (PARTITION BY pixel_id) AS n, x, v FROM pairs WHERE lag = 0),
r AS (SELECT a.pixel_id, s, corr(a.x, b.v) AS r FROM z a, (VALUES (0), (40), (80), (120)) t(s), z b WHERE b.pixel_id = a.pixel_id AND b.i = (a.i + s) % a.n GROUP BY ALL)
SELECT s::INT AS shift, count(*) AS cells, count(*) FILTER (abs(r) >= 0.05) AS beyond FROM r GROUP BY 1""")
def field_significance(spark, sf_dir):
    """Cells whose correlation is beyond a limit, with the whole field rolled by common offsets; offset 0 is the observed one."""
    w = Window.partitionBy("pixel_id")
    rows = lagged_pairs(spark, sf_dir).where("lag = 0").withColumn("i", F.row_number().over(w.orderBy("week_end")) - 1).withColumn("n", F.count("*").over(w))
    left = rows.select("pixel_id", "n", "x", "i", F.explode(F.array(*map(F.lit, (0, 40, 80, 120)))).alias("shift")).withColumn("i", F.pmod(F.col("i") + F.col("shift"), F.col("n")))
    r = left.join(rows.select("pixel_id", "i", F.col("v").alias("y")), ["pixel_id", "i"]).groupBy("pixel_id", "shift").agg(stats.pearson("x", "y").alias("r"))
    return r.groupBy("shift").agg(F.count("*").alias("cells"), F.count_if(F.abs("r") >= 0.05).alias("beyond"))


@query(f"""WITH {LAGGED}, e AS (SELECT pixel_id, lag, year(week_end) AS event, count(*) AS n, sum(x) AS sx, sum(v) AS sy, sum(x * x) AS sxx, sum(v * v) AS syy, sum(x * v) AS sxy FROM pairs GROUP BY ALL),
u AS (SELECT pixel_id, event, row_number() OVER (PARTITION BY pixel_id ORDER BY event) - 1 AS i, count(*) OVER (PARTITION BY pixel_id) AS n FROM (SELECT DISTINCT pixel_id, event FROM e)),
t AS (SELECT pixel_id, draw, ('0x' || substr(md5('42|' || draw || '|' || i), 1, 8))::BIGINT * n // 4294967296 AS i FROM u, range(100) r(draw)), w AS (SELECT t.pixel_id, draw, event, count(*) AS w FROM t JOIN u USING (pixel_id, i) GROUP BY ALL),
s AS (SELECT pixel_id, draw, lag, sum(n * w) AS n, sum(sx * w) AS sx, sum(sy * w) AS sy, sum(sxx * w) AS sxx, sum(syy * w) AS syy, sum(sxy * w) AS sxy FROM e JOIN w USING (pixel_id, event) GROUP BY ALL),
c AS (SELECT pixel_id, draw, lag, (n * sxy - sx * sy) / nullif(sqrt(greatest(0, (n * sxx - sx * sx) * (n * syy - sy * sy))), 0) AS r FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY pixel_id, draw ORDER BY abs(r) DESC, lag) AS k FROM c WHERE r IS NOT NULL)
SELECT pixel_id, lag, count(*) AS times FROM b WHERE k = 1 GROUP BY 1, 2""")
def event_bootstrap_lags(spark, sf_dir):
    """How often each lag is the best one of a cell when whole years are drawn again."""
    rows = lagged_pairs(spark, sf_dir).withColumn("event", F.year("week_end"))
    terms = {"n": F.lit(1.0), "sx": F.col("x"), "sy": F.col("v"), "sxx": F.col("x") * F.col("x"), "syy": F.col("v") * F.col("v"), "sxy": F.col("x") * F.col("v")}
    each = rows.groupBy("pixel_id", "lag", "event").agg(*[F.sum(e).alias(k) for k, e in terms.items()])
    taken = inference.drawn_units(each.select("pixel_id", "event").distinct(), ["pixel_id"], "event", 100)
    drawn = each.join(taken.withColumnRenamed("times", "w"), ["pixel_id", "event"])
    s = drawn.groupBy("pixel_id", "draw", "lag").agg(*[F.sum(F.col(k) * F.col("w")).alias(k) for k in terms])
    r = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.nullif(F.sqrt(F.greatest(F.lit(0.0), (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))), F.lit(0.0)))
    best = stats.best_lag(s.select("pixel_id", "draw", "lag", r.alias("r")), ["pixel_id", "draw"])
    return best.groupBy("pixel_id", "lag").agg(F.count("*").alias("times"))


@query("""SELECT 'orders_not_empty' AS "check", count(*) > 0 AS passed, 'error' AS severity, count(*)::VARCHAR AS detail FROM orders UNION ALL SELECT 'unique_order_key', count(*) = count(DISTINCT o_orderkey), 'error', (count(*) - count(DISTINCT o_orderkey))::VARCHAR FROM orders
UNION ALL SELECT 'price_positive', count(*) FILTER (o_totalprice <= 0) = 0, 'error', (count(*) FILTER (o_totalprice <= 0))::VARCHAR FROM orders UNION ALL SELECT 'status_known', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) = 0, 'warning', (count(*) FILTER (o_orderstatus NOT IN ('O', 'F')))::VARCHAR FROM orders""")
def master_checks(spark, sf_dir):
    """Named checks of a table in one pass."""
    n, twice = F.count("*"), F.count("*") - F.countDistinct("o_orderkey")
    bad, unknown = F.count_if(F.col("o_totalprice") <= 0), F.count_if(~F.col("o_orderstatus").isin("O", "F"))
    row = lambda name, passed, severity, detail: F.struct(F.lit(name).alias("check"), passed.alias("passed"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
    one = table(spark, sf_dir, "orders").agg(n.alias("n"), twice.alias("t"), bad.alias("b"), unknown.alias("u"))
    checks = [row("orders_not_empty", F.col("n") > 0, "error", F.col("n")), row("unique_order_key", F.col("t") == 0, "error", F.col("t")), row("price_positive", F.col("b") == 0, "error", F.col("b")), row("status_known", F.col("u") == 0, "warning", F.col("u"))]
    return one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS entries, count(*) - count(DISTINCT event_type) AS repeats, count(*) FILTER (props IS NULL) AS without_props FROM events GROUP BY 1")
def ledger_audit(spark, sf_dir):
    """Latest entry a task, repeated kinds, missing payloads."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("entries"), (F.count("*") - F.countDistinct("event_type")).alias("repeats"), F.count_if(F.col("props").isNull()).alias("without_props"))


@query(f"""WITH {CUBE} SELECT d, round(sum(v * cos(radians(lat)) * 6371000.0::DOUBLE ** 2 * radians(5.0::DOUBLE) * radians(14.4::DOUBLE)) / 1e15, 6) AS volume FROM cube GROUP BY d""")
def warm_water_volume(spark, sf_dir):
    """Thickness times the area of cells, summed."""
    return rounded(cube_daily(spark, sf_dir).groupBy("d").agg((F.sum(F.col("v") * grid.area_m2(F.col("lat"), 5.0, 14.4)) / 1e15).alias("volume")))


@query(f"""WITH {CUBE}, g AS (SELECT d, ((pixel_id // 5) * 5 - 10)::DOUBLE AS lat, ((pixel_id % 5) * 10 + 150)::DOUBLE AS lon, v AS tx, v * 0.5 + pixel_id AS ty FROM cube),
n AS (SELECT *, lead(ty) OVER x - lag(ty) OVER x AS dty, lead(lon) OVER x - lag(lon) OVER x AS dlon, lead(tx) OVER y - lag(tx) OVER y AS dtx, lead(lat) OVER y - lag(lat) OVER y AS dlat FROM g WINDOW x AS (PARTITION BY d, lat ORDER BY lon), y AS (PARTITION BY d, lon ORDER BY lat))
SELECT d, lat, lon, round((dty / (radians(dlon) * cos(radians(lat)) * 6371000) - dtx / (radians(dlat) * 6371000)) * 1e6, 6) AS curl FROM n""")
def wind_stress_curl(spark, sf_dir):
    rows = cube_daily(spark, sf_dir).select("d", (F.floor(F.col("pixel_id") / 5) * 5 - 10).cast("double").alias("lat"), ((F.col("pixel_id") % 5) * 10 + 150).cast("double").alias("lon"), F.col("v").alias("tx"), (F.col("v") * 0.5 + F.col("pixel_id")).alias("ty"))
    out = vertical.stress_curl(rows, "tx", "ty", ["d"])
    return rounded(out.select("d", "lat", "lon", (F.col("curl") * 1e6).alias("curl")))


@query(f"""WITH {CUBE_WEEKLY}, r AS (SELECT *, stddev_samp(v) OVER (PARTITION BY pixel_id) AS sd, (('0x' || substr(md5(pixel_id || '|' || week_end || '|42'), 1, 8))::BIGINT % 2001 - 1000) / 1000.0::DOUBLE AS noise FROM cw WHERE year(week_end) <= 1998)
SELECT pixel_id, week_end, round(v, 6) AS v, false AS is_synthetic, 1 AS independent_n FROM r UNION ALL SELECT pixel_id, week_end, round(v + noise * sd * 0.1, 6), true, 0 FROM r""")
def augmented_rows(spark, sf_dir):
    """Training rows with copies that carry small noise and their origin; the noise is a hash of the row, the same each time."""
    rows = cube_weekly(spark, sf_dir).where(F.year("week_end") <= 1998).withColumn("sd", F.stddev_samp("v").over(Window.partitionBy("pixel_id")))
    noise = (hash32("pixel_id", "week_end", F.lit(42)) % 2001 - 1000) / 1000.0
    copies = rows.select("pixel_id", "week_end", (F.col("v") + noise * F.col("sd") * 0.1).alias("v"), F.lit(True).alias("is_synthetic"), F.lit(0).alias("independent_n"))
    return rounded(rows.select("pixel_id", "week_end", "v", F.lit(False).alias("is_synthetic"), F.lit(1).alias("independent_n")).unionByName(copies))


@query(f"""WITH {CUBE_WEEKLY}, p AS (SELECT pixel_id, week_end, v, avg(v) OVER w AS m, 1.645 * stddev_pop(v) OVER w AS h, year(week_end)::INT AS fold FROM cw WINDOW w AS (PARTITION BY pixel_id ORDER BY week_end ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)),
e AS (SELECT fold, pixel_id, avg((abs(v - m) <= h)::INT) AS c FROM p WHERE h IS NOT NULL GROUP BY ALL) SELECT fold, round(avg(c), 6) AS coverage, abs(round(avg(c), 6) - 0.9) <= 0.1 AS passed FROM e GROUP BY 1""")
def interval_gate(spark, sf_dir):
    """Coverage of a 90 % interval, cells alike inside each fold, and whether it is near enough."""
    w = Window.partitionBy("pixel_id").orderBy("week_end").rowsBetween(-26, -1)
    rows = cube_weekly(spark, sf_dir).withColumn("m", F.avg("v").over(w)).withColumn("h", F.stddev_pop("v").over(w) * 1.645).where("h is not null").withColumn("fold", F.year("week_end"))
    each = rows.groupBy("fold", "pixel_id").agg(F.avg((F.abs(F.col("v") - F.col("m")) <= F.col("h")).cast("int")).alias("c"))
    out = each.groupBy("fold").agg(F.round(F.avg("c"), 6).alias("coverage"))
    return out.withColumn("passed", F.abs(F.col("coverage") - 0.9) <= 0.1)
