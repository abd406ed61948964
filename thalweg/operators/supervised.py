"""Leakage-safe tables for models: folds, weights, baselines, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def walk_forward_folds(first: int, last: int, train: int, validation: int, test: int, embargo_days: int) -> list[dict]:
    """Years of each fold; the test years follow one another without overlap."""
    out, start = [], first
    while start + train + validation + test - 1 <= last:
        a, b, c = start + train - 1, start + train + validation - 1, start + train + validation + test - 1
        out.append({"fold": len(out), "train_start": start, "train_end": a, "validation_end": b, "test_end": c, "embargo_days": embargo_days})
        start += test
    return out


def split_of(time: str | Column, f: dict) -> Column:
    """train, validation, test or null of a target's time in a fold; the last embargo days before a split belong to none."""
    time = F.col(time) if isinstance(time, str) else time
    day = lambda y: F.make_date(F.lit(y + 1), F.lit(1), F.lit(1))  # noqa: E731  the day after a year
    e = f["embargo_days"]
    return (
        F.when((time >= F.make_date(F.lit(f["train_start"]), F.lit(1), F.lit(1))) & (time < F.date_sub(day(f["train_end"]), e)), "train")
        .when((time >= day(f["train_end"])) & (time < F.date_sub(day(f["validation_end"]), e)), "validation")
        .when((time >= day(f["validation_end"])) & (time < day(f["test_end"])), "test")
    )


def event_folds(events: DataFrame, start: str = "onset", least: int = 1) -> DataFrame:
    """(event_id, fold, n_train): each event is a test of its own after at least ``least`` earlier ones."""
    n = F.row_number().over(Window.orderBy(start)) - 1
    return events.select("event_id", n.cast("long").alias("n_train")).where(F.col("n_train") >= least).withColumn("fold", F.col("n_train") - least)


def balanced_weights(df: DataFrame, event: str, phase: str) -> DataFrame:
    """Adds weight: rows of an event and phase share one, events of a phase share one, and the mean of all weights is 1."""
    each = F.lit(1.0) / F.count("*").over(Window.partitionBy(event, phase))
    events = df.select(event, phase).distinct().groupBy(phase).agg(F.count("*").alias("_e"))
    out = df.join(F.broadcast(events), phase).withColumn("_w", each / F.col("_e"))
    scale = out.agg((F.count("*") / F.sum("_w")).alias("_s"))
    return out.crossJoin(F.broadcast(scale)).withColumn("weight", F.col("_w") * F.col("_s")).drop("_w", "_s", "_e")


def regression_metrics(df: DataFrame, keys: list[str], observed: str = "y", predicted: str = "p") -> DataFrame:
    """(keys, n, bias, mae, rmse, r2)."""
    e = F.col(predicted) - F.col(observed)
    rows = df.where(F.col(observed).isNotNull() & F.col(predicted).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), F.nullif(F.var_pop(observed), F.lit(0.0)))).alias("r2"))


def classification_metrics(df: DataFrame, keys: list[str], observed: str = "y", predicted: str = "p") -> DataFrame:
    """(keys, tp, fp, fn, tn, precision, recall, f1, balanced_accuracy) of boolean columns."""
    o, p = F.col(observed), F.col(predicted)
    c = df.groupBy(*keys).agg(F.count_if(o & p).alias("tp"), F.count_if(~o & p).alias("fp"), F.count_if(o & ~p).alias("fn"), F.count_if(~o & ~p).alias("tn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    specificity = F.try_divide("tn", F.col("tn") + F.col("fp"))
    return c.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("balanced_accuracy", (recall + specificity) / 2)


def skill(df: DataFrame, keys: list[str], baseline: str, observed: str = "y", predicted: str = "p", weight: Column | None = None) -> DataFrame:
    """(keys, n, rmse, rmse_base, skill): all rows pooled before the roots; 1 - RMSE / RMSE of the baseline."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.where(F.col(observed).isNotNull() & F.col(predicted).isNotNull() & F.col(baseline).isNotNull())
    mse = lambda c: F.sum(w * (F.col(c) - F.col(observed)) * (F.col(c) - F.col(observed))) / F.sum(w)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(mse(predicted)).alias("rmse"), F.sqrt(mse(baseline)).alias("rmse_base"))
    return out.withColumn("skill", 1 - F.try_divide("rmse", F.nullif("rmse_base", F.lit(0.0))))


def event_equal_mean(df: DataFrame, event: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, mean, n_events): mean inside each event, then over events alike."""
    return df.groupBy(*keys, event).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.avg("_m").alias("mean"), F.count("_m").alias("n_events"))


def with_all(df: DataFrame, column: str, name: str = "all") -> DataFrame:
    """The rows once under their own value of a column and once under ``name``."""
    return df.withColumn(column, F.explode(F.array(F.col(column), F.lit(name))))


def sequences(df: DataFrame, value: str, length: int, horizon: int, keys: list[str], order: str) -> DataFrame:
    """(keys, order, history, target): the last ``length`` values and the one ``horizon`` rows on, where all are there."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("history", F.collect_list(value).over(w.rowsBetween(1 - length, 0))).withColumn("target", F.lead(value, horizon).over(w))
    return rows.where((F.size("history") == length) & F.col("target").isNotNull()).select(*keys, order, "history", "target")
