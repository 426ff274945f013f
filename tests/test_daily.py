"""Stations day by day against a walk outwards."""

import numpy as np
import pytest

from queuelens.operators import daily, gates, queue_model, weekday


def walked(v, v_co, bridge):
    """First and last bin of the queue around the lowest speed."""

    def breaks(i):
        if v[i] is not None:
            return v[i] >= v_co
        a = b = i
        while a > 0 and v[a - 1] is None:
            a -= 1
        while b < len(v) - 1 and v[b + 1] is None:
            b += 1
        return bridge is not None and b - a + 1 > bridge

    t2 = min((x, i) for i, x in enumerate(v) if x is not None)[1]
    a = b = t2
    while a > 0 and not breaks(a - 1):
        a -= 1
    while b < len(v) - 1 and not breaks(b + 1):
        b += 1
    return a, t2, b


@pytest.mark.parametrize("bridge", [None, 0, 3])
def test_days_against_a_walk(spark, bridge):
    rng, rows, series = np.random.default_rng(4), [], {}
    for day in range(30):
        v = [float(x) for x in 60 - 35 * np.exp(-(((np.arange(108) - 55) / rng.uniform(5, 25)) ** 2)) + rng.normal(0, 4, 108)]
        if day % 5 == 0:
            v = [60.0 + x % 3 for x in v]
        for _ in range(4):
            a = int(rng.integers(0, 100))
            for i in range(a, a + int(rng.integers(1, 8))):
                v[i] = None
        if day == 7:
            v = [x if i < 50 else None for i, x in enumerate(v)]  # too few known
        series[f"d{day:02d}"] = v
        rows += [("s", f"d{day:02d}", i, x, None if x is None else 1000.0 + i) for i, x in enumerate(v)]
    got = {r.date: r for r in daily.day_statistics(spark.createDataFrame(rows, "sensor_uid string, date string, i int, speed double, flow double"), bridge).collect()}
    known = [x for v in series.values() for x in v if x is not None]
    v_co, cap = 0.7 * np.percentile(known, 95), np.percentile([r[4] for r in rows if r[4] is not None], 98)
    assert "d07" not in got and len(got) == 29
    for date, r in got.items():
        v = series[date]
        a, t2, b = walked(v, v_co, bridge)
        if v[t2] >= v_co:
            assert (r.P, r.DC, r.vt2) == (0.0, None, None)
            continue
        q = [1000.0 + i for i in range(a, b + 1) if v[i] is not None]
        assert r.P == pytest.approx((b - a + 1) / 12) and r.DC == pytest.approx(sum(q) / 12 / cap) and r.vt2 == v[t2]
        assert r.mu == pytest.approx(np.median([1000.0 + i for i in range(t2, b + 1) if v[i] is not None])) and r.vbar == pytest.approx(np.mean([x for x in v[a : b + 1] if x is not None]))


def test_planted_laws(spark):
    rows = []
    for i in range(1, 13):
        dc = 0.4 * i
        p = 1.3 * dc**1.1
        rows.append(("s", f"d{i}", p, dc, 49 / (1 + 0.2 * p**1.4), 40.0, 1500.0, 49.0, 1800.0))
    rows += [("few", f"d{i}", 1.0 * i, 1.0 * i, 30.0, 35.0, 1.0, 49.0, 1.0) for i in range(1, 5)] + [("s", "free", 0.0, None, None, None, None, 49.0, 1800.0)]
    got = {r.sensor_uid: r for r in daily.station_laws(spark.createDataFrame(rows, "sensor_uid string, date string, P double, DC double, vt2 double, vbar double, mu double, v_co double, cap double")).collect()}
    s = got["s"]
    assert (s.f_d, s.n, s.f_p, s.s, s.r2) == pytest.approx((1.3, 1.1, 0.2, 1.4, 1.0)) and s.n_days == 12
    assert got["few"].f_d is None and got["few"].n_days == 4


def test_a_slow_day_stands_out_from_days_of_its_kind(spark):
    days = [f"2024-01-{d:02d}" for d in range(1, 15)]
    rows = [("C", f"s{k}", f"{d} {h:02d}:00:00", (20.0 if d == "2024-01-09" and 7 <= h < 10 else 45.0 if d in ("2024-01-06", "2024-01-07", "2024-01-13", "2024-01-14") else 60.0)) for k in range(3) for d in days for h in range(24)]
    df = spark.createDataFrame(rows, "corridor string, sensor_uid string, at string, speed_mph double").selectExpr("corridor", "sensor_uid", "cast(at as timestamp_ntz) as datetime", "speed_mph")
    got = {r.date: r for r in daily.anomaly_days(daily.median_residuals(df)).collect()}
    cut = 4 / np.sqrt(3 * 288)
    assert got["2024-01-09"].energy == pytest.approx(9 * (40 - cut)) and got["2024-01-09"].n_cells == 9
    assert all(r.energy == 0 for d, r in got.items() if d != "2024-01-09")


def test_mean_shapes_by_trapezoids(spark):
    tau = np.linspace(-1, 1, 201)
    shapes = {"quartic_symmetric": 1 - (1 - tau**2) ** 2, "quadratic_symmetric": tau**2, "quadratic_early": np.where(tau < 0, tau**2, np.abs(tau) ** 1.5)}
    df = spark.createDataFrame([(20.0, 70.0)], "min_speed_mph double, v_f_mph double")
    for name, phi in shapes.items():
        mean = float(np.trapezoid(phi, tau) / 2)
        got = queue_model.shape_predictions(df, name).first()
        assert (got.phi_mean, got.v_avg_pred, got.v_min_pred) == pytest.approx((mean, 20 + 50 * mean, 20.0))


def test_delay_by_period_has_no_negative_parts(spark):
    rows = [("a", t, 80.0 if t < 600 else 20.0, 400.0, 2.0, 0.5) for t in range(300, 1320, 15)] + [("few", t, 10.0, 400.0, 2.0, 0.5) for t in range(300, 390, 15)]
    df = spark.createDataFrame(rows, "link_id string, t_min int, speed double, flow_pl double, lanes double, length double")
    got = {r.period: r for r in weekday.period_accounting(df, spark.createDataFrame([("a", 70.0, 49.0), ("few", 70.0, 49.0)], "link_id string, vf double, uc double")).collect()}
    assert {p: r.vmt for p, r in got.items()} == {"AM": 2000.0, "MD": 1600.0, "PM": 2400.0, "NT": 800.0} and got["AM"].vdt == got["AM"].vcdt == 0
    pm = got["PM"]
    assert (pm.vht, pm.vdt, pm.vcdt, pm.avg_speed) == pytest.approx((120.0, 120 - 2400 / 70, 120 - 2400 / 49, 20.0)) and pm.delay_share_pct == pytest.approx(100 * (1 - 20 / 70))


def test_a_run_beside_its_reference(spark):
    schema = "period string, P_min double, v_t2_mph double, mu_obs_vphpl double, capacity_calibrated_vphpl double"
    now = spark.createDataFrame([("AM", 60.0, 30.0, 1500.0, 1800.0), ("AM", 90.0, 20.0, None, 1800.0), ("PM", 30.0, 40.0, 1400.0, None)], schema)
    got = {r.period: r for r in gates.run_comparison(now, spark.createDataFrame([("AM", 50.0, 31.0, 1600.0, 1.0), ("MD", 1.0, 1.0, 1.0, 1.0)], schema)).collect()}
    assert (got["AM"].n_valid, got["AM"].P_min_median, got["AM"].mu_median, got["AM"].ref_n_valid, got["AM"].ref_v_t2_median) == (2, 75.0, 1500.0, 1, 31.0)
    assert set(got) == {"AM", "PM"} and got["PM"].ref_n_valid is None and got["PM"].capacity_median is None
