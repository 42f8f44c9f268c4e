from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roadpass.functions import classes as C
from roadpass.functions import predicates as P
from roadpass.functions import sql
from roadpass.functions import text as X
from roadpass.functions import timekeys as K


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_parse_time_rolls_over_late_hours(spark):
    rows = [("2018-09-13 24:02:57",), ("2018-09-13 18:02:57",), ("2018-09-13 49:00:00",), ("broken",), (None,)]
    got = values(spark, rows, "t string", K.time_text(K.parse_time(F.col("t"))))
    assert got == ["2018-09-14 00:02:57", "2018-09-13 18:02:57", "2018-09-15 01:00:00", None, None]


def test_clock_ignores_daylight_saving(spark):
    # 02:30 does not exist on this day in the session's time zone.
    rows = [("2024-03-10 02:30:00",), ("2024-03-10 03:30:00",)]
    clock = K.clock(K.parse_time(F.col("t")))
    first, second = values(spark, rows, "t string", clock)
    assert second - first == 3600
    assert values(spark, rows, "t string", K.clock_text(clock)) == [r[0] for r in rows]


@pytest.mark.parametrize(
    "time, label",
    [
        ("2018-09-13 18:02:57", "2018-09-13 18:00~2018-09-13 18:05"),
        ("2018-09-13 18:57:00", "2018-09-13 18:55~2018-09-13 19:00"),
        ("2018-09-13 23:57:00", "2018-09-13 23:55~2018-09-14 00:00"),
    ],
)
def test_range_label(spark, time, label):
    start = K.range_start(K.clock(K.parse_time(F.col("t"))))
    assert values(spark, [(time,)], "t string", K.range_label(start)) == [label]


def test_time_keys(spark):
    row = [("2018-09-13 18:02:57",)]
    assert values(spark, row, "t string", K.date_hour(F.col("t"))) == ["2018-09-13_18"]
    assert values(spark, row, "t string", K.day_key(F.col("t"))) == ["20180913"]
    assert values(spark, row, "t string", K.minute_key(F.col("t"))) == ["1802"]


def test_time_order(spark):
    rows = [("2018-09-13 08:00:00", "2018-09-13 08:00:01")]
    a, b = F.col("a"), F.col("b")
    assert values(spark, rows, "a string, b string", K.is_before(a, b)) == [True]
    assert values(spark, rows, "a string, b string", K.is_after(a, b)) == [False]
    assert values(spark, rows, "a string, b string", K.seconds_between(b, a)) == [1]


def test_minute_index_crosses_midnight(spark):
    rows = [("20180913", "2359"), ("20180914", "0000")]
    first, second = values(spark, rows, "d string, m string", K.minute_index(F.col("d"), F.col("m")))
    assert second - first == 1


def test_flow_level_edges(spark):
    rows = [(n,) for n in (150, 151, 160, 161, 170, 171)]
    got = values(spark, rows, "n long", C.flow_level(F.col("n")))
    assert [g[0] for g in got] == ["D", "C", "C", "B", "B", "A"]


def test_speed_bands(spark):
    speeds = {0: "low", 59: "low", 60: "normal", 89: "normal", 90: "medium", 119: "medium", 120: "high"}
    df = spark.createDataFrame([(s,) for s in speeds] + [(-1,)], "speed int")
    bands = [F.when(C.in_band(F.col("speed"), b), b).alias(b) for b, _, _ in C.SPEED_BANDS]
    got = {r.speed: [v for v in r[1:] if v] for r in df.select("speed", *bands).collect()}
    assert got == {s: [b] for s, b in speeds.items()} | {-1: []}


def test_speed_class(spark):
    rows = [(47.9,), (135.0,), (99.9,), (100.0,), (0.0,)]
    assert values(spark, rows, "v double", C.speed_class(F.col("v"))) == [4.0, 10.0, 9.0, 10.0, 0.0]


def test_round_rate(spark):
    assert values(spark, [(0.125,), (0.375,)], "v double", C.round_rate(F.col("v"))) == [0.13, 0.38]


def test_text_helpers(spark):
    assert values(spark, [("7",), ("12",), ("123",)], "v string", X.zero_pad(F.col("v"))) == ["07", "12", "123"]
    assert values(spark, [("12",), (" 3 ",), ("x",), (None,)], "v string", X.to_int(F.col("v"))) == [12, 3, None, None]
    line = [("a\tb\tc",)]
    assert values(spark, line, "v string", X.tab_field(F.col("v"), 1)) == ["b"]
    assert values(spark, line, "v string", X.tab_field(F.col("v"), 7)) == [None]
    params = [('{"topNum":["3","9"],"cars":[]}',)]
    assert values(spark, params, "v string", X.first_param(F.col("v"), "topNum")) == ["3"]
    assert values(spark, params, "v string", X.first_param(F.col("v"), "cars")) == [None]
    assert values(spark, params, "v string", X.first_param(F.col("v"), "other")) == [None]


def test_prefix_round_trip_keeps_underscores(spark):
    salted = X.add_prefix(F.col("v"), F.lit(7))
    assert values(spark, [("a_b:1",)], "v string", salted) == ["7_a_b:1"]
    assert values(spark, [("a_b:1",)], "v string", X.drop_prefix(salted)) == ["a_b:1"]


def test_last_pairs(spark):
    df = spark.createDataFrame([("x", "a=1|b=2|a=3|bad|c=")], "id string, kv string")
    got = {(r.k, r.v) for r in X.last_pairs(df, ["id"], "kv").collect()}
    assert got == {("a", "3"), ("b", "2"), ("c", "")}


def test_predicates(spark):
    field = F.col("v")
    rows = [("5",), ("50",), (None,), ("x",)]
    assert values(spark, rows, "v string", P.in_range(field, 1, 10, text=True)) == [True, False, None, None]
    assert values(spark, rows, "v string", P.in_range(field, None, 10)) == [True] * 4
    lists = [("a,b",), ("c",), (None,)]
    assert values(spark, lists, "v string", P.overlaps(field, "b,d")) == [True, False, None]
    assert values(spark, lists, "v string", P.one_of(field, "c,d")) == [False, True, None]
    assert values(spark, lists, "v string", P.overlaps(field, None)) == [True] * 3
    assert values(spark, lists, "v string", P.equals(field, "c")) == [False, True, None]
    assert values(spark, lists, "v string", P.equals(field, None)) == [True] * 3


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql(
        "SELECT concat_string_string('a', 'b', ':') AS c, remove_random_prefix('3_a_b') AS r, "
        "random_prefix('v', 10) AS p"
    ).first()
    assert (row.c, row.r) == ("a:b", "a_b")
    assert row.p.split("_")[1] == "v" and 0 <= int(row.p.split("_")[0]) < 10
