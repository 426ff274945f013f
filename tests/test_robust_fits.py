"""Robust diagrams: fits that take their steps together, their slopes, and rows that arrive in any order."""

import numpy as np
import pytest

from queuelens.operators import fits


def _rows(sensor: str, n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    k = rng.uniform(5, 110, n)
    v = 68 / (1 + (k / 33) ** 3.4) ** (2 / 3.4) - rng.uniform(0, 6, n)
    return [(sensor, float(b), float(a * b), float(a)) for a, b in zip(k, v, strict=True)]


SCHEMA = "sensor_uid string, speed_mph double, flow_vph double, density_vpm double"


def test_order_of_arrival_is_open_to_no_result(spark):
    rows = [r for i in range(5) for r in _rows(f"s{i}", 300 + 40 * i, i)]
    mixed = [rows[i] for i in np.random.default_rng(9).permutation(len(rows))]

    def run(these: list[tuple], **kw) -> list[tuple]:
        return sorted(tuple(r) for r in fits.fit_diagrams(spark.createDataFrame(these, SCHEMA), **kw).collect())

    got = run(rows)
    assert got == run(mixed) and len({r[0] for r in got}) == 5
    alone = run(mixed, together=1)  # one sensor at a time: sums of other lengths, the same diagrams
    assert [r[:4] for r in alone] == [r[:4] for r in got]
    np.testing.assert_allclose([r[5] for r in alone], [r[5] for r in got], atol=1e-4)


@pytest.mark.parametrize("model", fits.ROBUST_MODELS)
def test_slopes_are_those_of_forward_differences(model):
    speed, lo, hi = fits.ROBUST_MODELS[model]
    k = np.array([[3.0, 20.0, 41.0, 90.0, 180.0]] * 2)
    p = np.array([np.array(lo) * 0.6 + np.array(hi) * 0.4, np.array(lo) * 0.1 + np.array(hi) * 0.9])
    v, slopes = fits.CURVES[model](k, np.log(k), *(p[:, i, None] for i in range(len(lo))))
    for i in range(2):
        np.testing.assert_allclose(v[i], speed(k[i], *p[i]), rtol=1e-12, atol=1e-12)
        for j, s in enumerate(slopes()):
            h = 1e-6 * max(1, p[i, j])
            moved = p[i] + h * (np.arange(len(lo)) == j)
            np.testing.assert_allclose(s[i], (speed(k[i], *moved) - speed(k[i], *p[i])) / h, rtol=2e-7, atol=1e-7)


def test_fits_together_are_those_alone():
    rng = np.random.default_rng(3)
    sets = []
    for n in (9, 10, 250, 1000, 40):
        k = rng.uniform(5, 120, n)
        sets.append((k, k * 65 * np.exp(-k / 45) + rng.normal(0, 30, n)))
    sets.append((np.array([np.nan, 0.0, -1.0, *range(1, 14), 1e300]), np.array([1.0, 1.0, 1.0, *range(60, 190, 10), np.inf])))
    for model in fits.ROBUST_MODELS:
        got = fits.huber_fits(sets, model)
        assert got[0] is None and all(g is not None for g in got[1:])
        for (k, q), g in zip(sets[1:], got[1:], strict=True):
            np.testing.assert_allclose(g[1], fits.huber_fit(k, q, model)[1], rtol=1e-4)
    p, r2, _ = fits.huber_fits(sets, "Underwood")[3]
    assert abs(p[0] - 65) < 2 and abs(p[1] - 45) < 2 and r2 > 0.95


def test_whole_months_leave_together():
    import pandas as pd

    table = pd.DataFrame({"sensor_uid": [None] * 3 + ["a"] * 9 + ["b"] * 2 + ["c"], "month": [1] * 7 + [2] * 8})
    table["density_vpm"] = table["flow_vph"] = table["speed_mph"] = np.arange(15.0)[::-1]
    for size in (1, 2, 4, 15):
        for together in (1, 4, 100):
            lists = list(fits._whole((table[i : i + size] for i in range(0, 15, size)), together))
            found = [x for some in lists for x in some]
            assert [(k, len(v[0])) for k, v in found] == [((None, 1), 3), (("a", 1), 4), (("a", 2), 5), (("b", 2), 2), (("c", 2), 1)]
            assert all((np.diff(v[0]) > 0).all() for _, v in found)
            assert len(lists) == {1: 5, 4: 3, 100: 1}[together]


def test_rows_without_a_time_are_month_0(spark):
    df = spark.createDataFrame(_rows("s", 60, 1), SCHEMA).selectExpr("*", "if(density_vpm < 60, timestamp'2024-01-05 00:00:00', null) as datetime")
    got = {(r.month, r.n) for r in fits.fit_diagrams(df).where("regime = 'full'").collect()}
    n = df.where("datetime is null").count()
    assert got == {(0, n), (2024 * 12, 60 - n)}
