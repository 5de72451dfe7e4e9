"""Lasting shifts, time frames, regular grids and nearest pairs: brute force and odd rows, cut and uncut."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from faultloom.operators import align, grid, shifts, timeframes

START = datetime.datetime(2021, 3, 1)
SCHEMA = "kpi_id string, event_time timestamp, value double, n long, note string"
CUTS = [5, 10_000]


def at(seconds):
    return None if seconds is None else START + datetime.timedelta(seconds=seconds)


def series(spark, rows):
    return spark.createDataFrame(
        [(k, at(t), v, i, None) for i, (k, t, v) in enumerate(rows)], SCHEMA).repartition(3)


def seconds(time):
    return (time - START).total_seconds()


# lasting shifts


def wave(n, noise=0.0, seed=1):
    rng = random.Random(seed)
    return [100.0 + (-1) ** i + noise * rng.gauss(0, 1) for i in range(n)]


@pytest.mark.parametrize("rows", [37, 10_000])
@pytest.mark.parametrize("sign,direction", [(1, "rise"), (-1, "fall")])
def test_a_lasting_shift_is_one_run_of_its_length(spark, rows, sign, direction):
    values = wave(1000)
    for i in range(400, 600):
        values[i] += 20 * sign * 1.4826  # deviations of a series whose median absolute deviation is 1
    df = series(spark, [("a", 60 * i, v) for i, v in enumerate(values)])
    got = shifts.level_shifts(df, ("n",), rows_per_slice=rows).collect()
    assert [(r["kpi_id"], r["direction"], seconds(r["run_start"]), seconds(r["run_end"]), r["run_length"]) for r in got] == [
        ("a", direction, 400 * 60.0, 599 * 60.0, 200)]


def plain_shifts(rows, allowance, threshold, clip, least):
    """By the definition, one value after the other."""
    out = []
    for k in {k for k, t, v in rows if k is not None}:
        points = sorted((t, i, v) for i, (kk, t, v) in enumerate(rows) if kk == k and t is not None and v is not None)
        values = [v for *_, v in points]
        if not values:
            continue
        centre = statistics.median(values)
        spread = 1.4826 * statistics.median(abs(v - centre) for v in values)
        for direction, sign in (("rise", 1), ("fall", -1)):
            height, run = 0, []
            for t, _, v in [*points, (None, None, None)]:
                if t is not None:
                    far = (v - centre) / spread if spread > 0 else ((v > centre) - (v < centre)) * clip
                    far = max(min(far, clip), -clip) * 1000
                    far = int(abs(far) + 0.5) * (1 if far >= 0 else -1)
                    height = max(0, height + sign * far - round(allowance * 1000))
                if t is None or height == 0:
                    if run:
                        top = max(h for h, _ in run)
                        end = [h for h, _ in run].index(top)
                        if top >= threshold * 1000 and end + 1 >= least:
                            out.append((k, direction, run[0][1], run[end][1], end + 1, top / 1000))
                    run = []
                else:
                    run.append((height, t))
    return sorted(out)


@pytest.mark.parametrize("rows", CUTS)
def test_shifts_equal_a_walk(spark, rows):
    rng = random.Random(3)
    points = [(f"k{i % 3}", 10 * (i // 4), rng.choice([0.0, 1.0, 2.0, 3.0, 9.0]) + 4 * (i // 100 % 3 == 1)) for i in range(600)]
    points += [("flat", i, 5.0 + (20 <= i < 29)) for i in range(60)]
    points += [(None, 5, 1.0), ("k0", None, 1.0), ("k1", 7, None), ("empty", 3, None)]
    got = shifts.level_shifts(series(spark, points), ("n",), 0.5, 1.5, 4.0, 2, rows_per_slice=rows)
    want = plain_shifts(points, 0.5, 1.5, 4.0, 2)
    assert len(want) > 10 and any(k == "flat" for k, *_ in want)
    assert sorted((r["kpi_id"], r["direction"], seconds(r["run_start"]), seconds(r["run_end"]), r["run_length"], r["strength"])
                  for r in got.collect()) == want
    assert shifts.level_shifts(series(spark, points[:0])).count() == 0


# time frames


@pytest.mark.parametrize("rows", CUTS)
@pytest.mark.parametrize("span", [30, 1000])
def test_time_frames_equal_a_scan(spark, rows, span):
    """Gaps, bursts, equal times, NULLs; the longer span reaches over many slices."""
    rng = random.Random(span)
    points, t = [], 0
    for i in range(150):
        t += rng.choice([0, 0, 1, 7, 15, 31, 400])
        points.append((rng.choice(["a", "a", "a", "b", None]), t, rng.choice([None, 1.5, 2.0, 8.0])))
    points += [("a", None, 4.0), ("c", 3, 2.0)]
    got = timeframes.add_time_rolling(series(spark, points), (span,), least=2, rows_per_slice=rows)
    assert got.columns == ["kpi_id", "event_time", "value", "n", "note", f"rolling_mean_{span}s", f"rolling_std_{span}s"]
    found = {r["n"]: r for r in got.collect()}
    assert len(found) == len(points)
    for i, (k, t, _) in enumerate(points):
        inside = [v for kk, s, v in points if kk == k and v is not None and t is not None and s is not None and t - span <= s <= t]
        mean, std = found[i][f"rolling_mean_{span}s"], found[i][f"rolling_std_{span}s"]
        if t is None or len(inside) < 2:
            assert mean is None and std is None
        else:
            assert mean == pytest.approx(statistics.mean(inside)) and std == pytest.approx(statistics.stdev(inside), abs=1e-9)


def shuffled_rows(df):
    """Rows written by all shuffles of the plan that ``collect`` ran."""
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        written = plan.metrics().get("shuffleRecordsWritten")
        total += written.get().value() if written.isDefined() else 0
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_time_frames_run_forwards_and_backwards(spark):
    """Every frame of the plan starts at its first row: none is evaluated anew for each row."""
    rng = random.Random(8)
    points = [("a", rng.randrange(4000), rng.choice([None, 1.5, 2.0, 8.0])) for _ in range(1200)]
    got = timeframes.add_time_rolling(series(spark, points), (30, 1000), least=2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan
    for r in got.collect():
        for span in (30, 1000):
            inside = [v for _, s, v in points if v is not None and points[r["n"]][1] - span <= s <= points[r["n"]][1]]
            want = (statistics.mean(inside), statistics.stdev(inside)) if len(inside) > 1 else (None, None)
            found = (r[f"rolling_mean_{span}s"], r[f"rolling_std_{span}s"])
            assert found == (want if want[0] is None else pytest.approx(want, abs=1e-9))


def test_time_frames_carry_one_row_a_slice(spark):
    """Frames that hold most of a cut key: what is shuffled keeps to a few rows for each row."""
    points = [("a", i, float(i % 7)) for i in range(1500)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = timeframes.add_time_rolling(series(spark, points), (1000,), rows_per_slice=20)
        found = {r["n"]: r for r in got.collect()}
        assert 0 < shuffled_rows(got) < 20 * len(points)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for i in range(0, 1500, 50):
        inside = [float(j % 7) for j in range(max(0, i - 1000), i + 1)]
        assert found[i]["rolling_mean_1000s"] == pytest.approx(statistics.mean(inside))
        if i:
            assert found[i]["rolling_std_1000s"] == pytest.approx(statistics.stdev(inside))


def test_time_frames_of_short_blocks(spark):
    """Blocks a little longer than a slice are cut into a few slices, not into one for every row, and
    what slices carry is added up before it is shuffled."""
    points = [("a", i, float(i % 7)) for i in range(2400)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = timeframes.add_time_rolling(series(spark, points), (40,), rows_per_slice=30)
        found = {r["n"]: r for r in got.collect()}
        assert 2 * len(points) < shuffled_rows(got) < 5 * len(points)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for i in range(1, 2400, 50):
        inside = [float(j % 7) for j in range(max(0, i - 40), i + 1)]
        assert found[i]["rolling_mean_40s"] == pytest.approx(statistics.mean(inside))
        assert found[i]["rolling_std_40s"] == pytest.approx(statistics.stdev(inside))


@pytest.mark.parametrize("rows", CUTS)
def test_time_frames_of_endless_and_huge_values(spark, rows):
    """Frames of one endless value repeated have no deviation; means of one huge or tiny value are exact."""
    values = [float("inf")] * 30 + [3e200] * 30 + [1e-300] * 30 + [0.1] * 30
    points = [("a", i, v) for i, v in enumerate(values)]
    found = {r["n"]: r for r in timeframes.add_time_rolling(series(spark, points), (9,), rows_per_slice=rows).collect()}
    for i in range(9, 120):
        inside = values[i - 9:i + 1]
        mean, std = found[i]["rolling_mean_9s"], found[i]["rolling_std_9s"]
        if len(set(inside)) == 1:
            assert mean == inside[0] and (std != std if mean == float("inf") else std == 0.0)


@pytest.mark.parametrize("rows", CUTS)
def test_time_frames_of_hard_values(spark, rows):
    """Large numbers close together, level shifts, level lines and values that are not finite."""
    rng = random.Random(9)
    values = [1.7e9 + rng.random() / 100 for _ in range(60)] + [0.1] * 60 + [rng.random() for _ in range(40)]
    values += [1e-3 * rng.random() + 1e6 * (i > 20) for i in range(40)] + [1.0, float("inf"), 2.0, 3.0] + [4.5] * 30
    points = [("a", i, v) for i, v in enumerate(values)]
    found = {r["n"]: r for r in timeframes.add_time_rolling(series(spark, points), (15,), rows_per_slice=rows).collect()}
    for i in range(len(values)):
        inside = values[max(0, i - 15):i + 1]
        mean, std = found[i]["rolling_mean_15s"], found[i]["rolling_std_15s"]
        if float("inf") in inside:
            assert mean == float("inf") and std != std
        elif len(inside) == 1:
            assert mean == inside[0] and std is None
        else:
            assert mean == pytest.approx(statistics.mean(inside), rel=1e-14)
            assert std == pytest.approx(statistics.stdev(inside), rel=1e-4) and (std == 0.0) == (len(set(inside)) == 1)


# grids


def plain_grid(points, step, method, longest):
    out = {}
    for k in {k for k, t, v in points if k is not None}:
        known = {}
        for kk, t, v in sorted(p for p in points if None not in p):
            if kk == k:
                known.setdefault(t, v)
        times = sorted(known)
        for t, u in zip(times, [*times[1:], None]):
            g = -(-t // step) * step
            while g == t or (u is not None and g < u and (longest is None or u - t <= longest)):
                line = known[t] + (known[u] - known[t]) * ((g - t) / (u - t)) if method == "linear" and g > t else known[t]
                out[k, g] = (line, int(g > t))
                g += step
    return out


@pytest.mark.parametrize("rows", CUTS)
@pytest.mark.parametrize("method,longest", [("forward", None), ("linear", None), ("linear", 300)])
def test_grid_fills_between_known_rows(spark, monkeypatch, rows, method, longest):
    monkeypatch.setattr(grid, "TICKS", 7)
    rng = random.Random(5)
    points, t = [], -500
    for _ in range(120):
        t += rng.choice([0, 20, 60, 60, 61, 119, 301, 2000])
        points.append((rng.choice(["a", "a", "b"]), t, rng.choice([None, 1.0, 2.5, 10.0])))
    points += [(None, 5, 1.0), ("a", None, 1.0), ("c", 60, 3.0), ("d", 61, 3.0), ("e", 7, None)]
    got = {(r["kpi_id"], seconds(r["event_time"])): (r["value"], r["filled"])
           for r in grid.regular_grid(series(spark, points), 60, method, longest, rows_per_slice=rows).collect()}
    want = plain_grid(points, 60, method, longest)
    assert got.keys() == want.keys() and ("c", 60) in got and not any(k in "de" for k, _ in got)
    for key, (value, filled) in want.items():
        assert got[key][1] == filled and got[key][0] == pytest.approx(value)
    with pytest.raises(ValueError):
        grid.regular_grid(series(spark, points), 60, "cubic")


def test_grid_of_a_huge_gap(spark):
    got = grid.regular_grid(series(spark, [("a", 0, 1.0), ("a", 500_000, 2.0)]), 1)
    assert got.count() == 500_001 and got.agg(F.sum("value")).first()[0] == 500_002


# nearest pairs


@pytest.mark.parametrize("rows", CUTS)
@pytest.mark.parametrize("direction", align.DIRECTIONS)
@pytest.mark.parametrize("tolerance", [None, 12])
def test_nearest_pairs_equal_a_search(spark, rows, direction, tolerance):
    rng = random.Random(11)
    left = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(0, 900, 3)]), 0.0) for _ in range(90)]
    right = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(0, 900, 7)]), float(rng.randint(0, 5))) for _ in range(70)]
    got = align.pair_nearest(
        series(spark, left).drop("note"), series(spark, right), ["kpi_id"], {"value": "near", "n": "m"}, tolerance, direction, rows_per_slice=rows)
    assert got.columns == ["kpi_id", "event_time", "value", "n", "near", "m", "gap_seconds"]
    found = {r["n"]: (r["near"], r["m"], r["gap_seconds"]) for r in got.collect()}
    assert len(found) == len(left)
    for i, (k, t, _) in enumerate(left):
        others = [(s - t, v, j) for j, (kk, s, v) in enumerate(right) if t is not None and s is not None and k is not None and kk == k]
        others = [o for o in others if direction == "nearest" or (o[0] <= 0) == (direction == "backward") or o[0] == 0]
        best = min((abs(g), g, -v, -j) for g, v, j in others) if others else None
        if best is None or (tolerance is not None and best[0] > tolerance):
            assert found[i] == (None, None, None)
        else:
            assert found[i] == (-best[2], -best[3], best[1])


def test_pairs_with_an_empty_side(spark):
    some, none = series(spark, [("a", 1, 1.0)]), series(spark, [])
    assert align.pair_nearest(some, none, ["kpi_id"], {"value": "near"}).first()["near"] is None
    assert align.pair_nearest(none, some, ["kpi_id"], {"value": "near"}).count() == 0
    with pytest.raises(ValueError):
        align.pair_nearest(some, some, ["kpi_id"], {"value": "near"}, direction="sideways")
