"""Queue-delay model: filters, log-log fits in closed form, calibration of single episodes and forward profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.functions.traffic import clip_to_default, shape

GROUP = ("sensor_uid", "period")


def with_ratios(episodes: DataFrame, capacity: DataFrame) -> DataFrame:
    """Adds P_hours, D_over_C (hours) and the mean congested speed; capacity: sensor_uid, capacity_vphpl, v_f_mph."""
    df = episodes.join(capacity, "sensor_uid", "left").fillna(70.0, ["v_f_mph"])
    mean = F.col("cong_mean_speed") if "cong_mean_speed" in episodes.columns else F.lit(None)
    return df.withColumns(
        {
            "P_hours": F.col("P_min") / 60,
            "D_over_C": F.col("demand_veh") / F.greatest(F.col("capacity_vphpl"), F.lit(1.0)),
            "cong_mean_speed": F.coalesce(mean, (F.col("v_f_mph") + F.col("min_speed_mph")) / 2),
        }
    )


def weekdays(episodes: DataFrame) -> DataFrame:
    return episodes.where(F.weekday(F.to_date("date")) < 5)


def difficult_days(episodes: DataFrame) -> DataFrame:
    """Episodes at or above the 90th percentile of duration in their group; groups of fewer than three go."""
    w = W.partitionBy(*GROUP)
    df = episodes.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_cut", F.percentile("P_min", F.lit(0.9)).over(w))
    return df.where("_n >= 3 and P_min >= _cut").drop("_n", "_cut")


def without_outliers(df: DataFrame, columns: tuple[str, ...] = ("P_min", "min_speed_mph", "D_over_C"), k: float = S.IQR_FACTOR) -> DataFrame:
    """Drops rows with a value outside [Q1 - k IQR, Q3 + k IQR] of its group; missing values and groups of fewer than
    four known values pass. All columns take one window."""
    w = W.partitionBy(*GROUP)
    for c in columns:
        df = df.withColumn(f"_q_{c}", F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).over(w)).withColumn(f"_n_{c}", F.count(c).over(w))
    keep = F.lit(True)
    for c in columns:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        keep = keep & ((F.col(f"_n_{c}") < 4) | F.col(c).isNull() | F.col(c).between(q1 - k * (q3 - q1), q3 + k * (q3 - q1)))
    return df.where(keep).drop(*[f"_{x}_{c}" for x in "qn" for c in columns])


def _power_fit(x: Column, y: Column, use: Column, out: tuple[str, str], sign: int = 1) -> list[Column]:
    """Aggregates of ln y = ln a + b ln x: a, b, R2 and points; null below the least number of points."""
    lx, ly = F.when(use, F.log(F.greatest(x, F.lit(1e-9)))), F.when(use, F.log(F.greatest(y, F.lit(1e-9))))
    n = F.count(F.when(use, 1))
    enough = lambda c: F.when(n >= S.MIN_FIT_POINTS, c)
    a, b = out
    return [enough(F.exp(F.regr_intercept(ly, lx))).alias(a), enough(sign * F.regr_slope(ly, lx)).alias(b), enough(F.regr_r2(ly, lx)).alias(f"r2_{a}"), n.alias(f"n_{a}")]


def fit_groups(episodes: DataFrame) -> DataFrame:
    """P = f_d (D/C - 1)^n, vf/v_t2 - 1 = alpha (D/C)^beta and v_avg/vf = f_p (D/C)^-s for each sensor and period: all
    three are linear in logarithms, so one aggregation has the answer."""
    doc, vf = F.col("D_over_C"), F.col("v_f_mph")
    usable = lambda v: (doc > 0) & (F.col(v) > 0) & (F.col(v) < vf * 1.05)
    return episodes.groupBy(*GROUP).agg(
        *_power_fit(doc - 1, F.col("P_hours"), (doc > 1.05) & (F.col("P_hours") > 0), ("f_d", "n")),
        *_power_fit(doc, F.greatest(vf / F.greatest(F.col("min_speed_mph"), F.lit(1.0)) - 1, F.lit(1e-6)), usable("min_speed_mph"), ("alpha", "beta")),
        *_power_fit(doc, F.col("cong_mean_speed") / vf, usable("cong_mean_speed"), ("f_p", "s"), -1),
    )


def calibrate(episodes: DataFrame) -> DataFrame:
    """Queue parameters of single episodes from P_hours, D_over_C, v_c_mph and min_speed_mph (raw and feasible)."""
    p, d, vc, v2 = (F.col(c) for c in ("P_hours", "D_over_C", "v_c_mph", "min_speed_mph"))
    given = (p > 0) & (d > 0)
    ln_d = F.log(d)
    ln_d = F.when(F.abs(ln_d) < 1e-6, F.when(ln_d >= 0, 1e-5).otherwise(-1e-5)).otherwise(ln_d)
    first = F.when(given, (F.log(p) - F.log(F.lit(S.Q_CD_ANCHOR))) / ln_d)
    low = first < 1.001
    df = episodes.withColumns(
        {
            "Q_n_raw": F.when(low, S.Q_N_FALLBACK).otherwise(first),
            "Q_cd_raw": F.when(low, p / F.greatest(F.pow(d, F.lit(S.Q_N_FALLBACK)), F.lit(1e-9))).otherwise(S.Q_CD_ANCHOR),
            "Q_cp_raw": F.when(given & (v2 > 0) & (vc > 0), (vc / F.greatest(v2, F.lit(1e-4)) - 1) / F.greatest(F.pow(p, F.lit(S.Q_S_ANCHOR)), F.lit(1e-5))),
            "calibration_status": F.when(~F.coalesce(given, F.lit(False)), "missing_inputs").when(low, "Q_n_below_1").otherwise("ok"),
        }
    )
    ok = F.col("calibration_status") != "missing_inputs"
    df = df.withColumns({f"Q_{x}": F.when(ok, clip_to_default(f"Q_{x}", f"Q_{x}_raw")).otherwise(S.FEASIBLE[f"Q_{x}"][0]) for x in ("n", "cd", "cp")})
    df = df.withColumn("Q_s", F.when(ok, F.lit(S.Q_S_ANCHOR)).otherwise(S.FEASIBLE["Q_s"][0]))
    a, b = 8 / 15 * F.col("Q_cp") * F.pow("Q_cd", "Q_s"), F.col("Q_n") * F.col("Q_s")
    return df.withColumns({"Q_alpha": F.when(ok, clip_to_default("Q_alpha", a)).otherwise(S.FEASIBLE["Q_alpha"][0]), "Q_beta": F.when(ok, clip_to_default("Q_beta", b)).otherwise(S.FEASIBLE["Q_beta"][0])})


def forward(calibrated: DataFrame) -> DataFrame:
    """Adds P_hat, vt2_hat, mu_hat, gamma and the average queue speed; needs capacity_vphpl, demand_veh and length_mi."""
    d = F.greatest(F.col("D_over_C"), F.lit(0.0))
    df = calibrated.withColumn("P_hat", clip_to_default("P_hours", F.col("Q_cd") * F.pow(d, "Q_n")))
    df = df.withColumn("vt2_hat", F.col("v_c_mph") / F.greatest(F.col("Q_cp") * F.pow("P_hat", "Q_s") + 1, F.lit(1e-3)))
    queued, cap = F.col("P_hat") > 0.15, F.col("capacity_vphpl")
    df = df.withColumn("mu_hat", F.when(queued, F.least(cap, F.col("demand_veh") / F.greatest(F.col("P_hat"), F.lit(0.01)))).otherwise(cap))
    wait = F.col("length_mi") / F.greatest(F.col("vt2_hat"), F.lit(1e-3)) - F.col("length_mi") / F.greatest(F.col("v_c_mph"), F.lit(1e-3))
    df = df.withColumn("gamma_hat", F.when(queued, wait * 64 * F.col("mu_hat") / F.pow(F.greatest(F.col("P_hat"), F.lit(1e-3)), F.lit(4.0))).otherwise(0.0))
    return df.withColumn("avg_queue_speed", F.col("v_c_mph") / (1 + F.col("Q_alpha") * F.pow(d, "Q_beta")))


def profile(predicted: DataFrame, t2_hour: str = "t2_hour", dt_min: float = S.DT_MIN) -> DataFrame:
    """The speed profile of each prediction in steps of dt_min: quartic queue inside, linear ramps outside. One row of
    steps is generated for each episode; nothing else is joined."""
    t2, span = F.col(t2_hour), F.greatest(F.col("P_hours"), F.col("P_hat")) * 0.6
    df = predicted.withColumns({"_a": F.greatest(F.lit(0.0), t2 - span), "_b": F.least(F.lit(24.0), t2 + span), "_t0": t2 - F.col("P_hat") / 2, "_t3": t2 + F.col("P_hat") / 2})
    df = df.withColumn("_n", F.greatest(F.lit(1), F.bround((F.col("_b") - F.col("_a")) * 60 / dt_min, 0).cast("int")))
    df = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("hour", F.col("_a") + F.col("step") * (F.col("_b") - F.col("_a")) / F.col("_n"))
    t, a, b, t0, t3 = (F.col(c) for c in ("hour", "_a", "_b", "_t0", "_t3"))
    queued = (t >= t0) & (t <= t3) & (F.col("P_hat") > 0.15)
    q = 0.25 * F.col("gamma_hat") * (t - t0) * (t - t0) * (t - t3) * (t - t3)
    edge, vf = F.greatest(F.col("v_c_mph"), F.col("avg_queue_speed")), F.col("v_f_mph")
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    rise, fall = unit((t - a) / F.greatest(F.lit(1e-3), t0 - a)), unit((t - t3) / F.greatest(F.lit(1e-3), b - t3))
    inside = F.col("length_mi") / F.greatest(q / F.greatest(F.col("mu_hat"), F.lit(1e-3)) + F.col("length_mi") / F.greatest(F.col("v_c_mph"), F.lit(1e-3)), F.lit(1e-6))
    speed = F.when(queued, inside).when(t < t0, (1 - rise) * vf + rise * edge).otherwise((1 - fall) * edge + fall * vf)
    return df.withColumn("td_speed_mph", speed).withColumn("td_queue_veh", F.when(queued, q).otherwise(0.0)).drop("_a", "_b", "_t0", "_t3", "_n")


def shape_fits(rows: DataFrame, keys: tuple[str, ...] = ("episode_id",)) -> DataFrame:
    """R2 of one-parameter projections of speed deficits on four shapes, and the best one. rows: keys, idx (from 0), n
    (bins of the episode), deficit. a = <d,F>/<F,F>, so sums are enough."""
    t, T_ = F.col("idx").cast("double"), (F.col("n") - 1).cast("double")
    ramp = F.greatest(0.25 * T_, F.lit(1.0))
    shapes = {
        "newell_quadratic": t * (T_ - t),
        "paq_cubic": t * (T_ - t) * (0.85 * T_ - t),
        "qvdf_quartic": 0.25 * t * t * (t - T_) * (t - T_),
        "trapezoid": F.greatest(F.lit(0.0), F.least(F.least(t / ramp, F.lit(1.0)), (T_ - t) / ramp)),
    }
    d = F.col("deficit")
    rows = rows.where(d.isNotNull())
    for name, f in shapes.items():
        rows = rows.withColumn(f"_{name}", f)
    sums = [F.sum(d * F.col(f"_{s}")).alias(f"df_{s}") for s in shapes] + [F.sum(F.col(f"_{s}") * F.col(f"_{s}")).alias(f"ff_{s}") for s in shapes]
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.sum(d * d).alias("dd"), (F.var_pop("deficit") * F.count(F.lit(1))).alias("ss"), *sums).where("points >= 6")
    for s in shapes:
        g = g.withColumn(s, F.when((F.col("ss") > 0) & (F.col(f"ff_{s}") > 0), F.bround(1 - (F.col("dd") - F.col(f"df_{s}") * F.col(f"df_{s}") / F.col(f"ff_{s}")) / F.col("ss"), 4)))
    best = F.array_max(F.array(*[F.struct(F.col(s).alias("r2"), F.lit(s).alias("name")) for s in shapes]))
    return g.select(*keys, "points", *shapes, best["name"].alias("winner"))


def mean_shape(name: str, steps: int = 200) -> Column:
    """The mean of a speed shape over its queue, from -1 to 1, by trapezoids."""
    at = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: shape(name, i * (2.0 / steps) - 1))
    weighted = F.transform(at, lambda x, i: F.when((i == 0) | (i == steps), x / 2).otherwise(x))
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) / steps


def shape_predictions(episodes: DataFrame, name: str = "quartic_symmetric") -> DataFrame:
    """Adds shape, phi_mean, and the mean and the lowest speed that the shape gives between v_t2 (min_speed_mph) and free
    flow (v_f_mph)."""
    low, phi = F.col("min_speed_mph"), F.col("phi_mean")
    return episodes.withColumns({"shape": F.lit(name), "phi_mean": mean_shape(name), "v_min_pred": low}).withColumn("v_avg_pred", low + (F.col("v_f_mph") - low) * phi)
