"""Fits that diverge, and cells on the edge of a count."""

import math

from queuelens.operators import daily, regressions


def test_regression_that_diverges_has_no_line(spark):
    """Over half of the rows are linear, the scale jumps and the line leaves all rows: no row is quadratic any more."""
    rows = [(-0.2, -1.1), (0.5, -0.3), (-0.8, -0.2), (0.0, 0.7), (-0.8, -2.7), (-1.0, -2.0), (-0.1, 1.6), (-0.6, 0.0), (-0.1, -0.6), (1.2, 2.2), (-0.9, 0.6), (0.9, 2.3)]
    df = spark.createDataFrame([("a", x, y) for x, y in rows] + [("b", float(i), 2.0 * i + (i % 3)) for i in range(40)], "g string, x double, y double")
    out = {r["g"]: r for r in regressions.huber_regressions(df, ("x",), "y", ("g",)).collect()}
    assert abs(out["b"]["coefs"][0] - 2) < 0.1
    assert out["a"]["intercept"] is None and out["a"]["coefs"] is None


def test_cells_on_the_cut_do_not_count(spark):
    """With eight sensors the cut is 1/12; a shortfall of 1/12 up to rounding isn't beyond it."""
    cut = 4 / math.sqrt(8 * 288)
    rows = [("C", f"S{i}", 0, "2024-01-01", -cut - e) for i, e in enumerate((0.0, 4e-15, -4e-15, 1e-3, 0.0, 0.0, 0.0, 0.0))]
    df = spark.createDataFrame(rows, "corridor string, sensor_uid string, slot int, date string, residual double")
    assert daily.anomaly_days(df).first()["n_cells"] == 1
