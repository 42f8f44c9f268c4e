from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from roadpass.functions import text
from roadpass.operators import companions, funnel, sampling, tracks

START = datetime(2024, 1, 1, 8)


def at(seconds: int) -> str:
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


def drive(car: str, monitors: str, step: int = 60):
    return [(car, m, at(i * step)) for i, m in enumerate(monitors.split())]


def counts(df):
    return [r.match_count for r in sorted(df.collect(), key=lambda r: r.step)]


def test_prefix_counts_golden(make_passes):
    passes = make_passes(drive("c", "1 2 3 6 7 8 1 2"))
    result = funnel.conversion(passes, ["1", "2", "3", "4", "5"])
    assert counts(result) == [2, 2, 1, 0, 0]
    rates = {r.step: r.rate for r in result.collect()}
    assert rates == {1: None, 2: 1.0, 3: 0.5, 4: 0.0, 5: None}
    only = funnel.conversion(passes, ["1", "2", "3", "4", "5"], rates_only=True)
    assert sorted(r.step for r in only.collect()) == [2, 3, 4]


def test_prefix_match_is_on_whole_ids(make_passes):
    assert counts(funnel.conversion(make_passes(drive("c", "11 2")), ["1", "2"])) == [0, 0]


def naive_counts(track: list[str], flow: list[str]) -> list[int]:
    return [
        sum(track[i : i + k] == flow[:k] for i in range(len(track))) for k in range(1, len(flow) + 1)
    ]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    track=st.lists(st.sampled_from(["1", "2"]), min_size=1, max_size=40),
    flow=st.lists(st.sampled_from(["1", "2"]), min_size=1, max_size=4),
    seconds=st.sampled_from([1, 30, 90, 3600]),
)
def test_prefix_counts_match_naive_scan(make_passes, track, flow, seconds):
    passes = make_passes(drive("c", " ".join(track), step=13))
    assert counts(funnel.conversion(passes, flow, slice_seconds=seconds)) == naive_counts(track, flow)


def test_counts_do_not_depend_on_slices(make_passes):
    rng = random.Random(3)
    times = sorted(rng.sample(range(50_000), 300))
    track = [rng.choice("123") for _ in times]
    rows = [("hot", m, at(t)) for m, t in zip(track, times)] + drive("cold", "1 2 3 1 2")
    flow = ["1", "2", "3", "1"]
    want = [a + b for a, b in zip(naive_counts(track, flow), naive_counts("1 2 3 1 2".split(), flow))]
    # The last one has a far pass alone in its slice.
    for seconds in (20, 600, 3600, 49_000):
        assert counts(funnel.conversion(make_passes(rows), flow, slice_seconds=seconds)) == want


def test_track_text_and_listed_cars(make_passes):
    passes = make_passes(drive("a", "m1 m2") + drive("b", "m3"))
    got = {(r.car, r.date): r.track for r in tracks.car_tracks(passes).collect()}
    assert got == {
        ("a", "2024-01-01"): "m1=2024-01-01 08:00:00|m2=2024-01-01 08:01:00",
        ("b", "2024-01-01"): "m3=2024-01-01 08:00:00",
    }
    assert [r.car for r in tracks.car_tracks(passes, cars=["b"]).collect()] == ["b"]


def test_every_car_has_one_row_a_day(make_passes):
    rows = [("busy", f"m{i}", at(i * 997)) for i in range(200)] + drive("calm", "m1 m2")
    passes = make_passes(rows)
    got = {(r.car, r.date): r.track for r in tracks.monitor_tracks(passes).collect()}
    assert {d for c, d in got if c == "busy"} == {"2024-01-01", "2024-01-02", "2024-01-03"}
    whole = ",".join(t for (c, _), t in sorted(got.items()) if c == "busy")
    assert whole == ",".join(f"m{i}" for i in range(200))
    assert got[("calm", "2024-01-01")] == "m1,m2"
    assert tracks.points(passes, ["calm"]).count() == 2


def test_last_visit_over_several_days(make_passes):
    rows = [("a", "m1", "2024-01-02 00:05:00"), ("a", "m2", at(0)), ("a", "m1", "2024-01-01 23:59:00")]
    passes = make_passes(rows + [("a", "m2", "2024-01-03 09:00:00"), ("b", "m1", at(5))])
    want = {("a", "m1"): "2024-01-02 00:05:00", ("a", "m2"): "2024-01-03 09:00:00", ("b", "m1"): at(5)}
    direct = {(r.car, r.monitor_id): r.action_time for r in tracks.last_visits(passes).collect()}
    assert direct == want
    texts = text.last_pairs(tracks.car_tracks(passes), ["car"], "track", order=["date"])
    assert {(r.car, r.k): r.v for r in texts.collect()} == want


def test_monitor_track_ends_at_midnight(make_passes):
    passes = make_passes([("a", "m1", "2024-01-01 23:59:00"), ("a", "m2", "2024-01-02 00:01:00")])
    got = {r.date: r.track for r in tracks.monitor_tracks(passes).collect()}
    assert got == {"2024-01-01": "m1", "2024-01-02": "m2"}


def test_null_car_is_kept(make_passes):
    passes = make_passes(drive(None, "m1 m2 m1") + drive("a", "m1"))
    got = {r.car: r.track for r in tracks.monitor_tracks(passes).collect()}
    assert got == {"a": "m1", None: "m1,m2,m1"}


def test_unreadable_time_keeps_its_place(make_passes):
    passes = make_passes([("a", "m1", "unknown", {"date": "2024-01-01"}), ("a", None, at(0))])
    assert [r.track for r in tracks.car_tracks(passes).collect()] == [f"m1=|={at(0)}"]
    assert [r.track for r in tracks.monitor_tracks(passes).collect()] == ["m1,"]


@pytest.mark.parametrize("last_only", [True, False])
def test_range_cars(make_passes, last_only):
    rows = [("a", "m", at(10)), ("b", "m", at(20)), ("a", "m", at(400))]
    got = {r.range_time: r.cars for r in tracks.range_cars(make_passes(rows), last_only).collect()}
    early, late = "2024-01-01 08:00~2024-01-01 08:05", "2024-01-01 08:05~2024-01-01 08:10"
    first = f"b={at(20)}" if last_only else f"a={at(10)}|b={at(20)}"
    assert got == {early: first, late: f"a={at(400)}"}


def near(rows, gap=300):
    return [
        (a, b)
        for a in rows
        for b in rows
        if a[1] == b[1]
        and a[0] != b[0]
        and abs((datetime.fromisoformat(a[2]) - datetime.fromisoformat(b[2])).total_seconds()) <= gap
    ]


def test_companions_against_brute_force(spark, make_passes):
    rng = random.Random(5)
    rows = [(rng.choice("abcd"), rng.choice(["m1", "m1", "m2"]), at(rng.randrange(4000))) for _ in range(80)]
    rows += [("a", "m9", at(0)), ("b", "m9", at(300)), ("c", "m9", at(301))]
    rows = sorted(set(rows))
    passes = make_passes(rows)
    pairs = near(rows)
    suspects = spark.createDataFrame([("a",), ("b",)], "car string")
    got = sorted(
        (r.car, r.companion, r.monitor_id, r.action_time, r.companion_time)
        for r in companions.companions_of(passes, suspects).collect()
    )
    assert got == sorted((a[0], b[0], a[1], a[2], b[2]) for a, b in pairs if a[0] in "ab")
    met = {(r.car, r.companion): (r.meetings, r.monitors) for r in companions.meetings(passes, suspects).collect()}
    for (car, other), (n, monitors) in met.items():
        mine = [a for a, b in pairs if a[0] == car and b[0] == other]
        assert (n, monitors) == (len(mine), len({a[1] for a in mine}))
    assert sum(n for n, _ in met.values()) == len(got)
    met = {r.car: r.encounters for r in companions.encounters(passes).collect()}
    assert met == {c: sum(a[0] == c for a, _ in pairs) for c in "abcd"}


def test_encounters_over_midnight(make_passes):
    rows = [("a", "m", "2024-01-01 23:58:00"), ("b", "m", "2024-01-02 00:01:00"), ("c", "m", "2024-01-02 00:04:00")]
    rows += [("a", "m", "2024-01-02 00:02:30"), ("d", "m", "2024-01-01 12:00:00"), ("b", "m", "unknown")]
    met = {r.car: r.encounters for r in companions.encounters(make_passes(rows)).collect()}
    want = {c: sum(a[0] == c for a, _ in near([r for r in rows if r[2] != "unknown"])) for c in "abcd"}
    assert met == want


def sampled(make_passes, rows, n, **kw):
    return sampling.sample_cars(make_passes(rows), n, **kw)


def test_equal_hours_share_the_sample(make_passes):
    rows = [(f"c{i}", "m", f"2024-01-01 {8 + i % 2:02d}:10:00") for i in range(100)]
    passes = make_passes(rows)
    quotas = {r.hour: (r.hour_cars, r.day_cars, r.quota) for r in sampling.hour_quotas(passes, 10).collect()}
    assert quotas == {"08": (50, 100, 5), "09": (50, 100, 5)}
    got = sampling.sample_cars(passes, 10).collect()
    assert sorted(r.hour for r in got) == ["08"] * 5 + ["09"] * 5
    again = sampling.sample_cars(passes.repartition(7), 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = sampling.sample_cars(passes, 10, seed=7).collect()
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))


def test_quota_is_capped_and_cars_count_once(make_passes):
    rows = [(f"c{i % 3}", "m", f"2024-01-01 08:{i:02d}:00") for i in range(30)]
    got = sampling.sample_cars(make_passes(rows), 500).collect()
    assert sorted(r.car for r in got) == ["c0", "c1", "c2"]


def test_one_hour_with_most_cars_is_sampled_exactly(make_passes):
    rows = [(f"h{i}", "m", "2024-01-01 08:00:00") for i in range(3000)]
    rows += [(f"q{i}", "m", f"2024-01-01 {9 + i % 10:02d}:00:00") for i in range(1000)]
    passes = make_passes(rows)
    quotas = {r.hour: r.quota for r in sampling.hour_quotas(passes, 1000).collect()}
    got = sampling.sample_cars(passes, 1000)
    drawn = {r.hour: r["count"] for r in got.groupBy("hour").count().collect()}
    assert drawn == {h: q for h, q in quotas.items() if q}
    assert got.distinct().count() == sum(quotas.values())


def test_sample_multiplicity(spark, make_passes):
    passes = make_passes(drive("a", "m1 m2") + drive("b", "m1"))
    sample = spark.createDataFrame(
        [("2024-01-01", "08", "a"), ("2024-01-01", "09", "a")], "date string, hour string, car string"
    )
    assert sampling.sample_passes(passes, sample, 10).count() == 2
    assert sampling.sample_passes(passes, sample, 10, keep_multiplicity=True).count() == 4
