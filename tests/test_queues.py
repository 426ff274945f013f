"""Queues along the road, chains, regressions and bounded diagram fits against plain loops and planted truths."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.functions import diagrams
from queuelens.operators import diagram_fits, episodes, queues, regressions

NOON = dt.datetime(2024, 1, 1, 8, 0)
ROAD = [("C", f"s{i}", float(i), 0.5 * i) for i in range(1, 8)]


def road_of(spark, rows=ROAD):
    return queues.mileposts(spark.createDataFrame(rows, "corridor string, sensor_uid string, road_order double, length_mi double"))


def test_mileposts_run_on_and_missing_lengths_count_as_none(spark):
    got = {r.sensor_uid: (r.place, r.milepost) for r in road_of(spark, [*ROAD[:3], ("C", "s4", 4.0, None), ("C", "s5", 5.0, 1.0), ("D", "x", 1.0, 2.0)]).collect()}
    assert got == {"s1": (1, 0.0), "s2": (2, 0.5), "s3": (3, 1.5), "s4": (4, 3.0), "s5": (5, 3.0), "x": (1, 0.0)}


@pytest.mark.parametrize(
    ("speeds", "tail", "miles"),
    [
        ({1: 30, 2: 30, 3: 30, 4: 30, 5: 30, 6: 20}, 5, 7.5),
        ({1: 30, 2: 30, 4: 30, 5: 30, 6: 20}, 2, 4.5),  # s3 says nothing then
        ({3: 30, 4: 60, 5: 30, 6: 20}, 1, 2.5),
        ({5: 50, 6: 20}, 0, 0.0),  # at the critical speed isn't below it
        ({7: 20, 6: 20}, 0, 0.0),  # downstream doesn't count
    ],
)
def test_queue_tails_end_at_the_first_place_that_breaks(spark, speeds, tail, miles):
    rows = spark.createDataFrame([(f"s{i}", NOON, float(v)) for i, v in speeds.items()] + [("s5", NOON + dt.timedelta(minutes=5), 10.0)], "sensor_uid string, datetime timestamp_ntz, speed_mph double")
    hours = lambda a, b, c: tuple(NOON + dt.timedelta(minutes=m) for m in (a, b, c))
    eps = [("C", "s6", "2024-01-01", "AM", *hours(-30, 0, 30), 50.0), ("C", "s5", "2024-01-01", "MD", *hours(20, 40, 60), 50.0), ("C", "s5", "2024-01-01", "AM", *hours(-10, 0, 10), 50.0), ("C", "s4", "2024-01-02", "AM", *hours(0, 0, 0), 50.0)]
    df = spark.createDataFrame(eps, "corridor string, sensor_uid string, date string, period string, t0_time timestamp_ntz, t2_time timestamp_ntz, t3_time timestamp_ntz, v_c_mph double")
    got = {(r.sensor_uid, r.period, r.date): r for r in queues.queue_tails(df, rows, road_of(spark)).collect()}
    e = got["s6", "AM", "2024-01-01"]
    assert (e.tail_sensors, e.tail_mi, e.meets) == (tail, miles, "AM")
    assert e.relation == ("Spillback" if tail else "Overlap") and got["s4", "AM", "2024-01-02"].relation == "Isolated"


def plain_span(q, over=0.3):
    peak = int(np.argmax(q))
    a = b = peak
    while a > 0 and q[a - 1] > over:
        a -= 1
    while b < len(q) - 1 and q[b + 1] > over:
        b += 1
    return a, b


def test_queue_lengths_and_spans_against_a_walk(spark):
    rng = np.random.default_rng(5)
    posts = np.cumsum(rng.uniform(0.2, 1.5, 6))
    road = spark.createDataFrame([("C", f"s{i}", i + 1, float(p)) for i, p in enumerate(posts)], "corridor string, sensor_uid string, place int, begin_mi double")
    field = {}
    for day in range(1, 9):
        level = rng.uniform(15, 60, 40) if day % 2 else np.concatenate([np.full(10, 60), 60 - 45 * np.sin(np.linspace(0, np.pi, 20)), np.full(10, 60)])
        for i in range(6):
            if day != 3 or i not in (2, 5):  # two sensors say nothing on a day
                field |= {(day, i, t): float(level[t] + rng.normal(0, 3)) for t in range(40) if rng.random() > 0.05}
    at = lambda d, t: dt.datetime(2024, 1, d, 6) + dt.timedelta(minutes=5 * t)
    rows = spark.createDataFrame([(f"s{i}", at(d, t), v) for (d, i, t), v in field.items()], "sensor_uid string, datetime timestamp_ntz, speed_mph double")
    lengths = queues.queue_lengths(rows, road)
    got = {(r.date, r.datetime): r.queue_mi for r in lengths.collect()}
    fits = {r.date: r for r in queues.span_fits(queues.queue_spans(lengths)).collect()}
    for d in range(1, 9):
        there = sorted({i for (x, i, _) in field if x == d})
        gradient = np.gradient(posts[there])
        times = sorted({t for (x, _, t) in field if x == d})
        q = np.array([sum(g for i, g in zip(there, gradient, strict=True) if field.get((d, i, t), 99) < 40) for t in times])
        date = f"2024-01-{d:02d}"
        assert [got[date, at(d, t)] for t in times] == pytest.approx(q.tolist())
        if q.max() < 1:
            assert date not in fits
            continue
        a, b = plain_span(q)
        fit, win, t = fits[date], q[a : b + 1], np.arange(b - a + 1.0)
        assert (fit.begin, fit.end, fit.n) == (at(d, times[a]), at(d, times[b]), b - a + 1)
        shape, ss = t * (t[-1] - t), ((win - win.mean()) ** 2).sum()
        if shape.any() and ss > 1e-12:
            scale = win @ shape / (shape @ shape)
            assert fit.scale_quadratic == pytest.approx(scale) and fit.r2_quadratic == pytest.approx(1 - ((win - scale * shape) ** 2).sum() / ss)
        else:
            assert fit.scale_quadratic is None or fit.r2_quadratic is None


def test_planted_trapezoid_is_found(spark):
    n, shape = 41, np.minimum(np.minimum(np.arange(41) / 10, 1), (40 - np.arange(41)) / 10)
    rows = [("C", "2024-01-01", NOON + dt.timedelta(minutes=5 * i), float(5 * max(x, 0.07))) for i, x in enumerate(shape)]
    fit = queues.span_fits(queues.queue_spans(spark.createDataFrame(rows, "corridor string, date string, datetime timestamp_ntz, queue_mi double"))).first()
    assert fit.n == n and fit.r2_trapezoid > 0.99 > fit.r2_quadratic > fit.r2_quartic and fit.scale_trapezoid == pytest.approx(5, rel=0.01)


def test_chains_by_pointer_doubling(spark):
    links = [(f"a{i:03d}", i, i + 1) for i in range(100)] + [("b", 500, 501), ("r1", 900, 901), ("r2", 901, 900), ("r3", 901, 950)]
    got = {r.link_id: (r.chain, r.place) for r in queues.chain_order(spark.createDataFrame(links, "link_id string, from_node_id long, to_node_id long").repartition(7)).collect()}
    assert got == {**{f"a{i:03d}": ("a000", i) for i in range(100)}, "b": ("b", 0)}  # a ring and what leaves it have no place


def test_marginals_conserve_flow(spark):
    counts = [5.0, 8.0, 6.0, 6.0]
    df = spark.createDataFrame([("a", f"l{i}", i, c, 1.0) for i, c in enumerate(counts)], "chain string, link_id string, place long, count double, length_mi double")
    got = sorted((r.node, r.on, r.off) for r in queues.chain_marginals(df).collect())
    assert got == [(1, 5.0, 0.0), (2, 3.0, 0.0), (3, 0.0, 2.0), (4, 0.0, 0.0), (5, 0.0, 6.0)]
    assert sum(x[1] for x in got) == sum(x[2] for x in got)


def huber_loss(x, y, beta, scale, eps=1.35, alpha=1e-4):
    r = np.abs(y - x @ beta)
    inside = r <= eps * scale
    return len(y) * scale + (r[inside] ** 2).sum() / scale + (2 * eps * r[~inside] - scale * eps**2).sum() + alpha * (beta[:-1] ** 2).sum()


def test_huber_regressions_reach_the_least_loss_in_every_group(spark):
    rng, rows, data = np.random.default_rng(8), [], {}
    for g in ("a", "b", "few"):
        n = 9 if g == "few" else 200
        x = rng.uniform(0, 4, (n, 2))
        y = x @ [30.0, -12.0] + 500 + rng.normal(0, 5, n) + (rng.random(n) < 0.15) * rng.normal(0, 400, n)
        data[g] = (np.c_[x, np.ones(n)], y)
        rows += [(g, float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)]
    rows += [("a", None, 1.0, 2.0), ("a", 1.0, float("nan"), 2.0), ("a", 1.0, 1.0, None)]
    got = {r.g: r for r in regressions.huber_regressions(spark.createDataFrame(rows, "g string, u double, v double, y double"), ("u", "v"), "y", ("g",)).collect()}
    assert got["few"].coefs is None and got["few"].n == 9
    for g in ("a", "b"):
        x, y = data[g]
        beta, scale = np.array([*got[g].coefs, got[g].intercept]), got[g].scale
        best = huber_loss(x, y, beta, scale)
        assert got[g].n == 200 and np.abs(beta - [30, -12, 500]).max() < 3
        for step in (1e-3, 1e-2, 1e-1):
            for _ in range(30):
                assert huber_loss(x, y, beta + rng.normal(0, step, 3), scale * (1 + rng.normal(0, step / 10))) >= best - 1e-7
        r = y - x @ beta
        assert got[g].r2 == pytest.approx(1 - (r @ r) / ((y - y.mean()) ** 2).sum())


def test_discharge_is_explained_in_both_modes(spark):
    eps = [("s", i % 2 == 0, 30.0 * i, 60.0 * i, 1500.0 + 10 * i if i % 2 == 0 else None) for i in range(1, 41)] + [("no capacity", True, 1.0, 60.0, 1.0)]
    df = spark.createDataFrame(eps, "sensor_uid string, is_valid_for_mu boolean, P_min double, demand_veh double, mu_obs_vphpl double")
    cap = spark.createDataFrame([("s", 1800.0), ("zero", 0.0)], "sensor_uid string, capacity_vphpl double")
    got = {r["mode"]: r for r in regressions.predicted_vs_observed(df, cap).collect()}
    assert got["valid_only"].n == 20 and got["all_days"].n == 40 and got["valid_only"].r2 > 0.99 > got["all_days"].r2
    assert regressions.r2_gap(regressions.predicted_vs_observed(df, cap)).first()[0] == pytest.approx(got["valid_only"].r2 - got["all_days"].r2)


def test_bounded_fits_of_planted_diagrams(spark):
    rng, rows = np.random.default_rng(1), []
    for g, (vf, kc, m) in {"a": (68, 32, 4.2), "b": (74, 27, 3.1)}.items():
        k = rng.uniform(4, 120, 900)
        v = vf / (1 + (k / kc) ** m) ** (2 / m) + rng.normal(0, 1.5, 900)
        rows += [(g, float(a), float(b), float(a * b)) for a, b in zip(k, v, strict=True) if b > 1]
    rows += [("a", None, 50.0, 1.0), ("a", 0.0, 50.0, 0.0), ("few", 10.0, 60.0, 600.0)]
    df = spark.createDataFrame(rows, "corridor string, density double, speed double, flow double")
    got = {(r.corridor, r.model): r for r in diagram_fits.fitted_diagrams(df).collect()}
    assert {g for g, _ in got} == {"a", "b"} and len(got) == 32
    for g, (vf, kc, m) in {"a": (68, 32, 4.2), "b": (74, 27, 3.1)}.items():
        s3 = got[g, "S3"]
        assert s3.params["vf"] == pytest.approx(vf, rel=0.01) and s3.params["kc"] == pytest.approx(kc, rel=0.02) and s3.params["m"] == pytest.approx(m, rel=0.03) and s3.rmse < 1.6
        assert s3.capacity == pytest.approx(vf * kc / 2 ** (2 / m), rel=0.01)
        speed = {model: r.rmse for (x, model), r in got.items() if x == g and model not in ("Van_Aerde", "Ni")}
        assert min(speed, key=speed.get) in ("S3", "Wang_5PL") and speed["KK"] == pytest.approx(speed["Wang_3PL"], rel=0.01)
        assert max(speed["Wang_4PL"], speed["MacNicholas"]) < min(speed["Greenshields"], speed["Underwood"], speed["Greenberg"], speed["GHR_M2"])
        for model, r in ((m, r) for (x, m), r in got.items() if x == g):
            for name, (_, lo, hi) in diagram_fits.BOUNDS[model].items():
                assert lo - 1e-9 <= r.params[name] <= (math.inf if hi is None else hi) + 1e-9


def test_bounded_fits_by_blocks(spark):
    """Groups of one block take their rounds in one task, so jobs don't multiply by rounds; cut into blocks they fit the same."""
    rng, rows = np.random.default_rng(4), []
    for g in ("a", "b"):
        k = rng.uniform(4, 120, 500)
        rows += [(g, float(a), float(b), float(a * b)) for a, b in zip(k, np.maximum(70 / (1 + (k / 30) ** 4) ** 0.5 + rng.normal(0, 1.5, 500), 1), strict=True)]
    df = spark.createDataFrame(rows, "corridor string, density double, speed double, flow double")
    spark.sparkContext.setJobGroup("one block", "")
    one = {(r.corridor, r.model): r for r in diagram_fits.fitted_diagrams(df).collect()}
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one block")) < 40
    many = {(r.corridor, r.model): r for r in diagram_fits.fitted_diagrams(df, block=100).collect()}
    assert len(one) == 32 and one.keys() == many.keys()
    for key, r in one.items():
        assert (r.n, r.rmse, r.flow_rmse, r.capacity) == (many[key].n, *(pytest.approx(x, rel=1e-3) for x in (many[key].rmse, many[key].flow_rmse, many[key].capacity)))


def test_curves_of_arrays_are_the_columns_ones(spark):
    x = np.linspace(1, 59, 30)
    df = spark.createDataFrame([(float(a),) for a in x], "x double")
    for model, params in diagram_fits.BOUNDS.items():
        p = {k: 0.5 if (model, k) == ("KK", "c2") else v[0] for k, v in params.items()}
        want = [r[0] for r in df.select(diagrams.predicted(model, "x", p)).collect()]
        assert diagram_fits.CURVES[model](x, *p.values()) == pytest.approx(np.array(want, float), rel=1e-9, abs=1e-12), model


def test_episodes_by_each_sensors_critical_speed(spark):
    rows = [(s, "C", NOON + dt.timedelta(minutes=5 * i), 40.0 if 3 <= i < 12 else 60.0, 1000.0 - i, 1.0) for s in ("low", "high", "none") for i in range(20)]
    df = spark.createDataFrame(rows, "sensor_uid string, corridor string, datetime timestamp_ntz, speed_mph double, flow_vph double, road_order double")
    by = spark.createDataFrame([("low", 35.0), ("high", 65.0)], "sensor_uid string, v_c_mph double")
    got = {r.sensor_uid: (r.P_min, r.v_c_mph) for r in episodes.find_episodes(df, by_sensor=by).where("period = 'AM'").collect()}
    assert got == {"low": (0.0, 35.0), "high": (100.0, 65.0), "none": (45.0, 50.0)}
    assert {r.sensor_uid: r.P_min for r in episodes.find_episodes(df, v_c=50.0).where(F.col("period") == "AM").collect()} == {s: 45.0 for s in ("low", "high", "none")}
