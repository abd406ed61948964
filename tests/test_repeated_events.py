"""Rows that are computed twice, and events that share an identifier."""

import datetime as dt

import duckdb
import pytest

from thalweg.operators import events, joins
from thalweg.plans import registry


def test_nearest_when_rows_come_in_another_order_each_time(spark):
    def shuffled(batches):
        import random

        import pyarrow as pa

        for b in batches:
            at = list(range(b.num_rows))
            random.SystemRandom().shuffle(at)
            yield b.take(pa.array(at))

    left = spark.range(500).selectExpr("id AS k", "cast(id % 7 AS double) AS z").mapInArrow(shuffled, "k long, z double")
    right = spark.range(500).selectExpr("id AS k", "cast(id % 7 AS double) + 1 AS at", "cast(id AS double) AS v")
    got = joins.nearest(left, right, ("k",), "z", "at", "v", 2.0).collect()
    assert sorted((r.k, r.v, r.distance) for r in got) == [(k, float(k), 1.0) for k in range(500)]


def test_nearest_keeps_repeated_and_unmatched_rows(spark):
    left = spark.createDataFrame([(1, 4.0), (1, 4.0), (1, None), (None, 4.0), (2, 4.0), (1, 90.0)], "k int, z double")
    right = spark.createDataFrame([(1, 3.0, 30.0), (1, 5.0, 50.0), (None, 4.0, 1.0)], "k int, at double, v double")
    got = joins.nearest(left, right, ("k",), "z", "at", "v", 2.0).collect()
    want = [*[(1, 4.0, 30.0, 1.0)] * 2, (1, None, None, None), (None, 4.0, None, None), (2, 4.0, None, None), (1, 90.0, None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_folds_of_two_events_with_one_identifier(spark, tmp_path):
    """A cold spell in spring and one in autumn of the middle year."""
    months = [(y, m) for y in (1995, 1996, 1997) for m in range(1, 13)]
    orders = [(dt.datetime(y, m, 15), 10.0 if y == 1996 and m in (1, 2, 3, 4, 8, 9, 10, 11) else 100.0) for y, m in months]
    spark.createDataFrame(orders, "o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"SELECT event_id, n_train, fold FROM ({registry.SQL['event_folds']})").fetchall()
    assert len({r[0] for r in want}) < len(want)
    got = registry.QUERIES["event_folds"](spark, str(tmp_path)).select("event_id", "n_train", "fold").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("ascending", [True, False])
def test_of_a_shared_identifiers_bands_the_later_holds(spark, ascending):
    d = dt.date
    rows = [("cold_2000", "cold", d(2000, 1, 1), d(2000, 2, 1), d(2000, 4, 1)), ("cold_2000", "cold", d(2000, 6, 1), d(2000, 7, 1), d(2000, 8, 1))]
    e = spark.createDataFrame(rows, "event_id string, event_type string, onset date, peak_time date, `end` date")
    bands = spark.createDataFrame([("cold_2000", d(2000, 2, 1), d(2000, 2, 29)), ("cold_2000", d(2000, 6, 1), d(2000, 7, 31))], "event_id string, peak_band_start date, peak_band_end date")
    bands = bands.repartition(1).sortWithinPartitions("peak_band_start", ascending=ascending)
    weeks = spark.createDataFrame([(d(2000, 2, 13),), (d(2000, 3, 19),), (d(2000, 7, 9),), (d(2000, 8, 20),)], "week_end date")
    for some in (e, e.coalesce(1)):
        assert [r.phase for r in events.lifecycle(weeks, some, bands).orderBy("week_end").collect()] == ["growth", "growth", "peak", "decay"]
