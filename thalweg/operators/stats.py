"""Correlation with autocorrelation-aware inference, false-discovery control, resampling by event."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.special import chi2_sf, ndtr, t_two_sided
from ..functions.text import hash32


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation of pairs in which both have a value, from one pass of sums; null for fewer than two or no variance."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    r = F.try_divide(F.covar_pop(F.when(both, x), F.when(both, y)), F.nullif(F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)), F.lit(0.0)))
    return F.when(F.count(F.when(both, 1)) >= 2, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def grouped_correlation(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", least: int = 30) -> DataFrame:
    """(keys, n, r) of each group with at least ``least`` pairs."""
    return pairs.groupBy(*keys).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), pearson(x, y).alias("r")).where(F.col("n") >= least)


def spearman(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, n, rho): correlation of mean ranks."""

    def mean_rank(c: str) -> Column:
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0

    ranked = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_a", mean_rank(x)).withColumn("_b", mean_rank(y))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson("_a", "_b").alias("rho"))


def pooled_correlation(df: DataFrame, event: str, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, n_events, r): centred inside each event, then pooled."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(event).isNotNull())
    each = ok.groupBy(*keys, event).agg(F.count("*").alias("n"), (F.covar_pop(x, y) * F.count("*")).alias("sxy"), (F.var_pop(x) * F.count("*")).alias("sxx"), (F.var_pop(y) * F.count("*")).alias("syy"))
    r = F.try_divide(F.sum("sxy"), F.nullif(F.sqrt(F.sum("sxx") * F.sum("syy")), F.lit(0.0)))
    return each.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("n_events"), r.alias("r"))


def lag1(df: DataFrame, value: str, keys: list[str], order: str, step_days: int | None = None) -> DataFrame:
    """(keys, rho1): lag-1 autocorrelation over neighbours (only ``step_days`` apart, if given); 0 without variance."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_b", F.lag(value).over(w)).withColumn("_g", F.datediff(order, F.lag(order).over(w)))
    if step_days is not None:
        rows = rows.withColumn("_b", F.when(F.col("_g") == step_days, F.col("_b")))
    return rows.groupBy(*keys).agg(F.coalesce(pearson(value, "_b"), F.lit(0.0)).alias("rho1"))


def effective_n(n: Column, a: Column, b: Column, low: float = 3.0) -> Column:
    """n (1 - ab) / (1 + ab), the product clipped to .99 and the result to [low, n]."""
    ab = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), a * b))
    return F.greatest(F.lit(low), F.least(n.cast("double"), n * (1 - ab) / (1 + ab)))


@F.pandas_udf(DoubleType())
def p_of_r(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation with (effective) n."""
    r, n = r.to_numpy(float), n.to_numpy(float)
    with np.errstate(all="ignore"):
        t = r * np.sqrt((n - 2) / np.maximum(1 - r * r, 1e-15))
        p = t_two_sided(np.abs(t), np.maximum(n - 2, 1e-9))
    return pd.Series(np.where(np.isfinite(r) & (n > 2), p, np.nan)).replace({np.nan: None})


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % interval of a correlation."""
    centre, half = F.atanh(r), z / F.sqrt(n - 3)
    return F.tanh(centre - half), F.tanh(centre + half)


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Adds q: the least p * m / rank of this or a larger p; null for a null p, which counts for nothing.

    Ranks are counted in strips of p, an eighth of a power of two wide and 64 times as fine near 1, so that many rows
    without keys are many tasks; the strips of a key are a table of bounded size, over which counts and least values are carried on.
    """
    ok = F.col(p).isNotNull()
    log = -F.log2(F.greatest(F.col(p), F.lit(1e-300)))
    strip = F.when(ok, F.when(log < 4, 100_000 - F.floor(log * 512)).otherwise(90_000 - F.floor(log * 8))).cast("int")
    rows = df.withColumn("_strip", strip)
    same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    sizes = rows.where(ok).groupBy(*keys, "_strip").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*keys)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(by.orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_m", F.sum("_n").over(by)).drop("_n")
    joined = rows.alias("_l").join(sizes.alias("_r"), [*same, F.col("_l._strip") == F.col("_r._strip")], "left").select("_l.*", "_r._before", "_r._m")
    inside = Window.partitionBy(*keys, "_strip")
    joined = joined.withColumn("_k", F.when(ok, F.row_number().over(inside.orderBy(F.col(p).asc()))))
    joined = joined.withColumn("_q", F.when(ok, F.col(p) * F.col("_m") / (F.col("_before") + F.col("_k"))))
    least = joined.where(ok).groupBy(*keys, "_strip").agg(F.min("_q").alias("_least"))
    least = least.withColumn("_after", F.min("_least").over(by.orderBy("_strip").rowsBetween(1, Window.unboundedFollowing))).drop("_least")
    out = joined.alias("_l").join(least.alias("_r"), [*same, F.col("_l._strip") == F.col("_r._strip")], "left").select("_l.*", "_r._after")
    tail = F.min("_q").over(inside.orderBy("_k").rowsBetween(0, Window.unboundedFollowing))
    return out.withColumn("q", F.when(ok, F.least(F.lit(1.0), tail, F.col("_after")))).select(*df.columns, "q")


def simes(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """(keys, simes): least p * m / rank, in [0, 1]."""
    rows = df.where(F.col(p).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(p)))
    return rows.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min(F.col(p) / F.col("_r")) * F.count("*"))).alias("simes"))


def leave_one_out(df: DataFrame, event: str, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, event, r_without, r_all, same_sign): the correlation without each event, from sums over the rest."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    terms = {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "syy": F.col(y) * F.col(y), "sxy": F.col(x) * F.col(y)}
    each = ok.groupBy(*keys, event).agg(*[F.sum(e).alias(k) for k, e in terms.items()])
    w = Window.partitionBy(*keys)
    tot = {k: F.sum(k).over(w) for k in terms}

    def r(s: dict[str, Column]) -> Column:
        return F.try_divide(s["n"] * s["sxy"] - s["sx"] * s["sy"], F.nullif(F.sqrt(F.greatest(F.lit(0.0), (s["n"] * s["sxx"] - s["sx"] * s["sx"]) * (s["n"] * s["syy"] - s["sy"] * s["sy"]))), F.lit(0.0)))

    out = each.select(*keys, event, r({k: tot[k] - F.col(k) for k in terms}).alias("r_without"), r(tot).alias("r_all"))
    return out.withColumn("same_sign", F.signum("r_without") == F.signum("r_all"))


def circular_shifts(df: DataFrame, order: str, x: str, y: str, shifts: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, shift, r): correlation with y rolled by each of a stated list of offsets, all rows of a key wrapping around."""
    n = Window.partitionBy(*keys)  # the axis of weeks is one short series a key
    rows = df.withColumn("_i", F.row_number().over(n.orderBy(order)) - 1).withColumn("_n", F.count("*").over(n))
    left = rows.select(*keys, "_i", "_n", F.col(x).alias("a"), F.explode(F.array(*map(F.lit, shifts))).alias("shift")).withColumn("_i", F.pmod(F.col("_i") + F.col("shift"), F.col("_n")))
    return left.join(rows.select(*keys, "_i", F.col(y).alias("b")), [*keys, "_i"]).groupBy(*keys, "shift").agg(pearson("a", "b").alias("r"))


def shift_p(null: DataFrame, observed: Column | float) -> DataFrame:
    """(p): (1 + number of shifts at least as far from zero) / (1 + number of shifts)."""
    return null.agg(((1 + F.count_if(F.abs("r") >= F.abs(F.lit(observed) if isinstance(observed, float) else observed))) / (1 + F.count("*"))).alias("p"))


def friedman(df: DataFrame, block: str, treatment: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, k, chi2, w): Friedman's statistic over blocks that have every treatment, and Kendall's W."""
    k = df.groupBy(*keys).agg(F.countDistinct(treatment).alias("k"))
    rows = df.join(k, list(keys)) if keys else df.crossJoin(F.broadcast(k))
    b = Window.partitionBy(*keys, block)
    rows = rows.withColumn("_c", F.count(value).over(b)).where(F.col("_c") == F.col("k"))
    rank = F.rank().over(b.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, block, value)) - 1) / 2.0
    sums = rows.withColumn("_r", rank).groupBy(*keys, treatment, "k").agg(F.sum("_r").alias("s"), F.count("*").alias("n"))
    out = sums.groupBy(*keys, "k").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    chi2 = 12.0 / (F.col("n") * F.col("k") * (F.col("k") + 1)) * F.col("ss") - 3.0 * F.col("n") * (F.col("k") + 1)
    return out.select(*keys, "n", "k", chi2.alias("chi2"), (chi2 / (F.col("n") * (F.col("k") - 1))).alias("w"))


def kruskal(df: DataFrame, group: str, value: str, keys: tuple[str, ...] = (), least: int = 10) -> DataFrame:
    """(keys, n, k, h, epsilon2): Kruskal-Wallis H without tie correction over groups of ``least`` rows or more, and its effect size."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_g", F.count("*").over(Window.partitionBy(*keys, group))).where(F.col("_g") >= least)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0
    each = rows.withColumn("_r", rank).groupBy(*keys, group).agg(F.sum("_r").alias("s"), F.count("*").alias("n"))
    out = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("t"))
    h = 12.0 / (F.col("n") * (F.col("n") + 1)) * F.col("t") - 3.0 * (F.col("n") + 1)
    return out.select(*keys, "n", "k", h.alias("h"), F.greatest(F.lit(0.0), F.try_divide(h - F.col("k") + 1, (F.col("n") - F.col("k")).cast("double"))).alias("epsilon2"))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution."""
    return pd.Series(chi2_sf(x.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """Normal distribution function; null for null."""
    x = z.to_numpy(float)
    return pd.Series(np.where(np.isnan(x), np.nan, ndtr(x))).replace({np.nan: None})


def block_bootstrap(df: DataFrame, order: str, x: str, y: str, block: int, draws: int, seed: int = 42, step_days: int = 7, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n_draws, low, high, same_sign): percentile interval of a correlation over moving blocks that never cross a gap.

    Block starts are drawn by hashes of (seed, draw, place), so a repeated run draws the same, and all keys draw alike; the draws are rows, and each is one aggregation.
    """
    beside = lambda a, b: a.join(b, list(keys)) if keys else a.crossJoin(b)
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)  # one short series a key
    rows = ok.withColumn("_i", F.row_number().over(w) - 1).withColumn("_run", F.datediff(order, F.lit("1970-01-01")) - F.row_number().over(w) * step_days)
    starts = rows.withColumn("_last", F.count("*").over(Window.partitionBy(*keys, "_run").orderBy("_i").rowsBetween(0, block - 1))).where(F.col("_last") == block)
    starts = starts.withColumn("_s", F.row_number().over(Window.partitionBy(*keys).orderBy("_i")) - 1).select(*keys, "_s", F.col("_i").alias("first"))
    counts = beside(rows.groupBy(*keys).agg(F.count("*").alias("n")), starts.groupBy(*keys).agg(F.count("*").alias("m"))).where("m > 0")
    picks = counts.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), F.ceil(F.col("n") / block).cast("int").alias("per"))
    picks = picks.select(*keys, "draw", "m", F.explode(F.sequence(F.lit(0), F.col("per") - 1)).alias("place")).withColumn("_s", (hash32(F.lit(seed), F.col("draw"), F.col("place")) % F.col("m")).cast("int"))
    taken = picks.join(starts, [*keys, "_s"]).select(*keys, "draw", F.explode(F.sequence(F.col("first"), F.col("first") + block - 1)).alias("_i")).join(rows.select(*keys, "_i", x, y), [*keys, "_i"])
    each = taken.groupBy(*keys, "draw").agg(pearson(x, y).alias("r"))
    seen = ok.groupBy(*keys).agg(pearson(x, y).alias("r0"))
    drawn = seen.join(each, list(keys), "left") if keys else each.crossJoin(F.broadcast(seen))  # a key without a whole block has no draw
    return drawn.groupBy(*keys).agg(F.count("r").alias("n_draws"), F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"), F.avg((F.signum("r") == F.signum("r0")).cast("double")).alias("same_sign"))


def best_lag(df: DataFrame, keys: list[str], lag: str = "lag", r: str = "r") -> DataFrame:
    """One row a key: the lag of largest absolute r, the shortest of equal ones."""
    rest = [c for c in df.columns if c not in keys]
    return df.where(F.col(r).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.abs(r), -F.col(lag))).alias("b")).select(*keys, "b.*")


def capped_top(df: DataFrame, family: str, score: str, name: str, k: int, cap: int) -> DataFrame:
    """The k best rows with at most ``cap`` of a family. Greedy choice under one cap is the cap first, then the k best."""
    inside = df.withColumn("_f", F.row_number().over(Window.partitionBy(family).orderBy(F.col(score).desc(), F.col(name)))).where(F.col("_f") <= cap).drop("_f")
    return inside.orderBy(F.col(score).desc(), F.col(name)).limit(k)


def conditioned_correlations(df: DataFrame, keys: list[str], event: str, order: str, x: str, y: str, step_days: int, least: int = 10) -> DataFrame:
    """(keys, n, n_events, r, n_eff): correlation in each condition, null under ``least`` pairs, and its effective size.

    Lag-one correlations only take pairs of rows that follow one another inside an event, so no event's end meets the next one's start.
    """
    w = Window.partitionBy(*keys, event).orderBy(order)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    near = F.datediff(order, F.lag(order).over(w)) == step_days
    rows = rows.withColumn("_px", F.when(near, F.lag(x).over(w))).withColumn("_py", F.when(near, F.lag(y).over(w)))
    serial = lambda v, before: F.coalesce(F.nanvl(pearson(v, before), F.lit(None).cast("double")), F.lit(0.0))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(event).alias("n_events"), F.when(F.count("*") >= least, pearson(x, y)).alias("r"), serial(x, "_px").alias("_ax"), serial(y, "_py").alias("_ay"))
    return out.withColumn("n_eff", effective_n(F.col("n"), F.col("_ax"), F.col("_ay"))).drop("_ax", "_ay")


def partial_correlation_of(df: DataFrame, keys: list[str], x: str, y: str, controls: list[str]) -> DataFrame:
    """(keys, n, r): correlation of what a linear fit on all controls leaves of both, by taking away one control after the other."""
    names = [x, y, *controls]
    ok = df.dropna(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = ok.groupBy(*keys).agg(F.count("*").alias("n"), *[pearson(a, b).alias(f"_{a}_{b}") for a, b in pairs])
    r = {frozenset(p): F.col(f"_{p[0]}_{p[1]}") for p in pairs}
    left = names
    for c in controls:
        left = [v for v in left if v != c]
        r = {frozenset((a, b)): F.try_divide(r[frozenset((a, b))] - r[frozenset((a, c))] * r[frozenset((b, c))], F.nullif(F.sqrt((1 - r[frozenset((a, c))] ** 2) * (1 - r[frozenset((b, c))] ** 2)), F.lit(0.0))) for i, a in enumerate(left) for b in left[i + 1 :]}
    return out.select(*keys, "n", r[frozenset((x, y))].alias("r"))


def variance_inflation(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, variable, vif): diagonal of the inverse of the predictors' correlations, a small matrix a key."""
    import numpy as np
    import pandas as pd

    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = df.dropna(subset=names).groupBy(*keys).agg(*[pearson(a, b).alias(f"_{a}_{b}") for a, b in pairs])

    @F.pandas_udf("array<double>")
    def diagonal(table: pd.DataFrame) -> pd.Series:
        rows = []
        for r in table.to_dict("records"):
            m = np.eye(len(names))
            for a, b in pairs:
                i, j = names.index(a), names.index(b)
                m[i, j] = m[j, i] = r[f"_{a}_{b}"]
            rows.append(np.diag(np.linalg.pinv(m)).tolist() if np.isfinite(m).all() else [None] * len(names))
        return pd.Series(rows)

    out = out.withColumn("_v", diagonal(F.struct(*[f"_{a}_{b}" for a, b in pairs])))
    return out.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("variable"), F.col("_v").alias("vif"))).alias("_z")).select(*keys, F.col("_z.variable"), F.col("_z.vif"))


def correlation_components(df: DataFrame, names: list[str], limit: float) -> dict[str, str]:
    """First name of the component of each variable, two being linked by a correlation of ``limit`` or more; one row of sums comes back."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs]).first().asDict()
    up = {n: n for n in names}

    def top(n: str) -> str:
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        r = row[f"{a}|{b}"]
        if r is not None and abs(r) >= limit:
            low, high = sorted((top(a), top(b)))
            up[high] = low
    return {n: top(n) for n in names}


def average_linkage(distance: dict[tuple[str, str], float], names: list[str], limit: float) -> dict[str, str]:
    """First name of the cluster of each variable: the two nearest clusters, by the mean distance of their members, are joined while it is under ``limit``.

    For the few dozen variables of a table; ``distance`` has every pair of names once, in the order of ``names``.
    """
    groups = [[n] for n in names]
    of = lambda a, b: distance.get((a, b), distance.get((b, a)))
    while len(groups) > 1:
        mean, i, j = min((sum(of(a, b) for a in x for b in groups[j]) / (len(x) * len(groups[j])), i, j) for i, x in enumerate(groups) for j in range(i + 1, len(groups)))
        if mean >= limit:
            break
        groups[i] += groups.pop(j)
    return {n: min(g) for g in groups for n in g}


def rank_distances(df: DataFrame, names: list[str], id_col: str) -> dict[tuple[str, str], float]:
    """1 less the absolute rank correlation of every pair of columns; a rank is that of a value, so a column of few values has few ranks to sort."""
    ranked = df.select(id_col)
    for n in names:
        counts = df.groupBy(F.col(n).alias("_v")).agg(F.count("*").alias("_c"))
        mean = counts.withColumn("_rank", F.sum("_c").over(Window.orderBy("_v")) - (F.col("_c") - 1) / 2.0).select("_v", "_rank")  # one row a value
        ranked = ranked.join(df.select(id_col, F.col(n).alias("_v")).join(mean, "_v").select(id_col, F.col("_rank").alias(n)), id_col)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = ranked.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs]).first().asDict()
    return {(a, b): 1 - abs(row[f"{a}|{b}"] or 0.0) for a, b in pairs}


def permutation_importance(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """(keys, feature, importance): growth of the squared error of a regression when its predictor is shuffled within the key by a hash."""
    by = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(by.orderBy(order))).withColumn("_k", F.row_number().over(by.orderBy(F.md5(F.col(order).cast("string")))))
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_b"))
    shuffled = rows.join(rows.select(*keys, F.col("_k").alias("_i"), F.col(x).alias("_x")), [*keys, "_i"]).join(fit, keys)
    error = lambda v: F.avg((F.col(y) - F.col("_b") - F.col("_s") * F.col(v)) ** 2)
    return shuffled.groupBy(*keys).agg((error("_x") - error(x)).alias("importance")).withColumn("feature", F.lit(x))
