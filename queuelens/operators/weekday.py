"""The average-weekday method: quarter-hour bins, weekday profiles, diagrams, congestion episodes, calibration and quality.

Rows: link_id, date, t_min, weekday (Monday is 0), speed, flow_pl, lanes, length. Everything but the two-parameter fits is
window expressions and aggregates; a fit sees a link's few bins or days, never its rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.functions import metrics
from queuelens.functions.traffic import smoothstep
from queuelens.operators.runs import low_runs
from queuelens.session import cut

PARAMETERS = ("f_d", "n", "f_p", "s")


def quarter_hours(rows: DataFrame, minutes: int = S.DEMO_DT) -> DataFrame:
    """Means of each link, date and bin."""
    at = (F.floor(F.col("t_min") / minutes) * minutes).cast("int")
    return rows.groupBy("link_id", "date", at.alias("t_min")).agg(
        F.avg("speed").alias("speed"), F.min("weekday").alias("weekday"), F.min("lanes").alias("lanes"), F.min("length").alias("length"), F.avg("flow_pl").alias("flow_pl")
    )


def profiles(bins: DataFrame, each_day: bool = False) -> DataFrame:
    """One average profile of a link's working days, or one for each day of the week."""
    day = F.col("weekday").cast("string") if each_day else F.lit("Weekday")
    rows = bins if each_day else bins.where("weekday < 5")
    return rows.groupBy("link_id", day.alias("date"), "t_min").agg(F.avg("speed").alias("speed"), F.avg("flow_pl").alias("flow_pl"), F.min("length").alias("length"), F.min("lanes").alias("lanes"))


def smoothed(rows: DataFrame, half: int = 1) -> DataFrame:
    """Adds sm: the centred mean of the speeds of a link's day."""
    return rows.withColumn("sm", F.avg("speed").over(W.partitionBy("link_id", "date").orderBy("t_min").rowsBetween(-half, half)))


def s3_speed(density: Column, vf: Column, kc: Column, m: Column) -> Column:
    return vf / F.pow(1 + F.pow(density / kc, m), 2 / m)


def inverse_s3_flow(speed: Column, vf: Column, kc: Column, m: Column) -> Column:
    v = F.least(F.greatest(speed, F.lit(1.0)), 0.99 * vf)
    ratio = F.greatest(F.pow(vf / v, m / 2) - 1, F.lit(1e-8))
    return F.least(kc * F.pow(ratio, 1 / m) * v, kc * vf)


def _known_density(bins: DataFrame) -> DataFrame:
    return bins.where("speed > 0 and flow_pl > 0").withColumn("density", F.col("flow_pl") / F.col("speed")).where("density >= 1 and density < 220")


def outer_layer(bins: DataFrame, least: int = 30) -> DataFrame:
    """Points of a link's diagram: for each band of speed its mean, and the mean of the densities from their 90th
    percentile on. Links with fewer than ``least`` rows have none."""
    link = W.partitionBy("link_id")
    df = _known_density(bins).withColumns({"n": F.count(F.lit(1)).over(link), "width": F.greatest(F.lit(1), F.floor((F.max("speed").over(link) - F.min("speed").over(link)) / 20)).cast("int")}).where(F.col("n") >= least)
    df = df.withColumn("band", F.floor(F.col("speed") / F.col("width")).cast("int"))
    df = df.withColumn("from", F.percentile("density", F.lit(S.DEMO_OUTER)).over(W.partitionBy("link_id", "band")))
    return df.groupBy("link_id", "band").agg(F.avg(F.when(F.col("density") >= F.col("from"), F.col("density"))).alias("density"), F.avg("speed").alias("speed"), F.max("density").alias("most"))


def bounded_fit(f: Callable, x: np.ndarray, y: np.ndarray, start: tuple, low: tuple, high: tuple, steps: int = 200) -> np.ndarray:
    """Least squares of y = f(x, *p) with bounds: projected Levenberg-Marquardt."""
    lo, hi, p, damp = np.array(low, float), np.array(high, float), np.array(start, float), 1e-3
    r = f(x, *p) - y
    for _ in range(steps):
        h = 1e-7 * np.maximum(1, np.abs(p))
        h = np.where(p + h > hi, -h, h)
        jac = np.stack([(f(x, *(p + d)) - y - r) / h[i] for i, d in enumerate(np.diag(h))], axis=1)
        a, g = jac.T @ jac, jac.T @ r
        free = ~((p <= lo) & (g > 0) | (p >= hi) & (g < 0))  # a parameter that presses on its bound stays there
        if not free.any():
            break
        moved = False
        for _ in range(30):
            step = np.zeros_like(p)
            step[free] = np.linalg.lstsq((a + damp * np.diag(np.maximum(np.diag(a), 1e-12)))[np.ix_(free, free)], -g[free], rcond=None)[0]
            new = np.clip(p + step, lo, hi)
            r_new = f(x, *new) - y
            if r_new @ r_new < r @ r:
                moved = np.abs(new - p).max() > 1e-10
                p, r, damp = new, r_new, max(damp / 5, 1e-12)
                break
            damp *= 4
        if not moved:
            break
    return p


def _power(x: np.ndarray, a: float, b: float) -> np.ndarray:
    return a * np.power(x, b)


def fit_diagrams(points: DataFrame, links: DataFrame) -> DataFrame:
    """The S-shaped diagram of each link through its outer layer, the free-flow speed fixed; the prior's diagram where
    there are fewer than four points or the fit is implausible. links: link_id, vf, capacity_prior. A task sees a link's
    points, one a band of speed."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        vf, prior = float(pdf.vf.iloc[0]), float(pdf.capacity_prior.iloc[0])
        uc = vf / 2**0.5
        out = (vf, prior / uc, 4.0, uc, prior, "prior")
        p = pdf.dropna(subset=["density"])
        if len(p) >= 4:
            k, v = p.density.to_numpy(float), p.speed.to_numpy(float)
            kc, m = bounded_fit(lambda x, kc, m: vf / (1 + (x / kc) ** m) ** (2 / m), k, v, (min(max(p.most.max() * 0.3, 10), 100), 5.0), (10, 1), (100, 12))
            uc = vf / 2 ** (2 / m)
            if 700 < uc * kc < 2800 and 25 < uc < vf:
                out = (vf, kc, m, uc, uc * kc, "fit")
        return pd.DataFrame([(pdf.link_id.iloc[0], *out)], columns=["link_id", "vf", "kc", "m", "uc", "cap", "source"])

    rows = links.join(points, "link_id", "left").select("link_id", "vf", "capacity_prior", "density", "speed", "most")
    return rows.groupBy("link_id").applyInPandas(fit, "link_id string, vf double, kc double, m double, uc double, cap double, source string")


def diagram_r2(bins: DataFrame, diagrams: DataFrame, least: int = 30) -> DataFrame:
    """R2 of speed against the diagram's speed at the observed density, for links with ``least`` rows."""
    rows = _known_density(bins).join(diagrams.select("link_id", "vf", "kc", "m"), "link_id")
    model = s3_speed(F.col("density"), F.col("vf"), F.col("kc"), F.col("m"))
    return rows.groupBy("link_id").agg(F.count(F.lit(1)).alias("n"), metrics.r2(F.col("speed"), model).alias("fd_r2")).where(F.col("n") >= least)


def _period(minute: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (a, b) in S.DEMO_PERIODS.items():
        out = F.when((minute >= a) & (minute < b), name).otherwise(out)
    return out


def congestion(rows: DataFrame, diagrams: DataFrame, least_bins: int = 8) -> DataFrame:
    """Episodes of each link and day in the wide window, by the period of their trough: duration, demand over capacity,
    lowest speed, crossing times, share of the day's demand. A day without one has a row of P = 0 for each period.

    Runs meet their rows again by an equi-join on link and date with the crossing times as a range condition. Rows and runs
    are read several times and written once.
    """
    lo, hi = S.DEMO_WINDOW
    day = W.partitionBy("link_id", "date")
    df = rows.where((F.col("t_min") >= lo) & (F.col("t_min") < hi)).withColumn("n", F.count(F.lit(1)).over(day)).where(F.col("n") >= least_bins)
    df = cut(smoothed(df).join(diagrams.select("link_id", "cap", (F.col("vf") * S.DEMO_CUTOFF).alias("cutoff")), "link_id").select("link_id", "date", "t_min", "flow_pl", "sm", "cutoff", "cap"))
    hours, keys = S.DEMO_DT / 60, ["link_id", "date"]
    days = df.groupBy(*keys).agg(F.sum(F.col("flow_pl") * hours).alias("total"), F.min(F.struct("sm", "t_min")).alias("least"), F.avg("sm").alias("mean"), F.first("cutoff").alias("cutoff"), F.first("cap").alias("cap"))
    runs = cut(low_runs(df, keys).withColumn("period", _period(F.col("t2_min"))).where(F.col("period").isNotNull() & ((F.col("t3_min") - F.col("t0_min")) / 60 >= S.DEMO_MIN_EPISODE_H)))
    inside = runs.join(df.select(*keys, "t_min", "flow_pl", "sm"), keys).where("t_min between t0_min and t3_min")
    sums = inside.groupBy(*keys, "i_start").agg(F.sum(F.col("flow_pl") * hours).alias("demand"), F.avg("sm").alias("cd_mean_speed"))
    found = runs.join(sums, [*keys, "i_start"], "left").join(days.select(*keys, "total", "cap"), keys)
    hour = lambda c: F.col(c) / 60
    demand, p = F.coalesce("demand", F.lit(0.0)), (F.col("t3_min") - F.col("t0_min")) / 60
    out = found.select(
        *keys, "period", p.alias("P"), demand.alias("demand"), F.least(demand / F.col("cap"), F.lit(S.DEMO_DOC_MAX)).alias("DC"), "v_t2", hour("t2_min").alias("t2"), hour("t0_min").alias("t0"), hour("t3_min").alias("t3"),
        F.when(F.col("total") > 0, demand / F.col("total")).otherwise(0.0).alias("qdf"), F.coalesce("cd_mean_speed", "v_t2").alias("cd_mean_speed"), F.when(F.col("v_t2") > 0, F.col("cutoff") / F.col("v_t2") - 1).otherwise(0.0).alias("magnitude"), "cutoff",
    )
    free = days.join(runs.select(*keys).distinct(), keys, "left_anti").withColumn("period", F.explode(F.array(*map(F.lit, S.DEMO_PERIODS))))
    zero = F.lit(0.0)
    return out.unionByName(
        free.select(
            *keys, "period", zero.alias("P"), F.col("total").alias("demand"), F.least(F.col("total") / F.col("cap"), F.lit(S.DEMO_DOC_MAX)).alias("DC"), F.col("least.sm").alias("v_t2"), (F.col("least.t_min") / 60).alias("t2"), zero.alias("t0"), zero.alias("t3"),
            F.lit(1.0).alias("qdf"), F.col("mean").alias("cd_mean_speed"), zero.alias("magnitude"), "cutoff",
        )
    )


def congested_days(episodes: DataFrame) -> DataFrame:
    """Days, congested days, their share in per cent and mean duration of each link and period."""
    some = F.when(F.col("P") > 0, F.col("date"))
    return episodes.groupBy("link_id", "period").agg(
        F.countDistinct("date").alias("n_days"), F.countDistinct(some).alias("n_congested"), F.bround(F.countDistinct(some) / F.countDistinct("date") * 100, 0).alias("pct_congested"), F.bround(F.coalesce(F.avg(F.when(F.col("P") > 0, F.col("P"))), F.lit(0.0)), 2).alias("mean_P")
    )


def calibrate(episodes: DataFrame, keys: tuple[str, ...] = ("link_id", "period")) -> DataFrame:
    """f_d, n (P = f_d DC^n) and f_p, s (magnitude = f_p P^s) of each group by bounded fits through the means at each
    duration; groups with fewer than three congested days or three durations have none. Longest episodes (over the mean
    plus a standard deviation) are trimmed; censored ones count only where too few others are left."""
    g = W.partitionBy(*keys)
    df = episodes.where("P > 0").withColumn("clean", (F.col("DC") < S.DEMO_DOC_MAX - 0.01) & (F.col("P") <= 8))
    df = df.withColumn("n_clean", F.count_if("clean").over(g)).where((F.col("n_clean") >= S.DEMO_MIN_DAYS) & F.col("clean") | (F.col("n_clean") < S.DEMO_MIN_DAYS) & (F.col("P") <= 12))
    df = df.withColumn("n_cong", F.count(F.lit(1)).over(g)).where(F.col("n_cong") >= S.DEMO_MIN_DAYS)
    df = df.withColumn("_most", F.avg("P").over(g) + F.stddev_samp("P").over(g)).where("P <= _most")
    means = df.groupBy(*keys, F.round("P", 4).alias("P")).agg(F.avg("DC").alias("DC"), F.greatest(F.avg("magnitude"), F.lit(0.0)).alias("magnitude"), F.first("n_cong").alias("n_cong"))
    kinds = {f.name: f.dataType.simpleString() for f in episodes.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", f_d double, n double, f_p double, s double, n_cong long"
    lo, hi = S.DEMO_BOUNDS

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 3:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        p, dc, mag = (pdf[c].to_numpy(float) for c in ("P", "DC", "magnitude"))
        a, b = (bounded_fit(_power, x, y, (1.0, 1.0), (lo, lo), (hi, hi)) for x, y in ((dc, p), (p, mag)))
        return pd.DataFrame([(*key, *a, *b, int(pdf.n_cong.iloc[0]))], columns=[c.split()[0] for c in schema.split(", ")])

    out = means.groupBy(*keys).applyInPandas(fit, schema)
    bound = lambda c: (F.abs(F.col(c) - hi) < 0.05) | (F.col(c) < 0.02)
    out = out.withColumn("at_bound", bound("f_d") | bound("n") | bound("f_p") | bound("s"))
    low = (F.col("n_cong") < S.DEMO_MIN_DAYS + 4) | F.col("at_bound")
    return out.withColumn("reliability", F.when((F.col("n_cong") >= S.DEMO_HIGH_DAYS) & ~F.col("at_bound"), "high").when(low, "low").otherwise("medium"))


def shrink(params: DataFrame, over: tuple[str, ...] = ("period",)) -> DataFrame:
    """Draws links that aren't of high reliability to the median of all links, by n / (n + k0); adds alpha and beta."""
    w, a = W.partitionBy(*over), F.col("n_cong") / (F.col("n_cong") + S.DEMO_K0)
    drawn = F.col("reliability") != "high"
    df = params.withColumns({f"_m_{p}": F.percentile(p, F.lit(0.5)).over(w) for p in PARAMETERS})
    df = df.withColumns({p: F.when(drawn, a * F.col(p) + (1 - a) * F.col(f"_m_{p}")).otherwise(F.col(p)) for p in PARAMETERS})
    df = df.drop(*[f"_m_{p}" for p in PARAMETERS])
    return df.withColumns({"shrunk": drawn, "alpha": 8 / 15 * F.col("f_p") * F.pow("f_d", "s"), "beta": F.col("n") * F.col("s")})


def calibration_quality(episodes: DataFrame, params: DataFrame, least: int = 3) -> DataFrame:
    """Fit and accuracy of each period: R2 of both steps over all links, errors of duration, lowest speed and times.
    params: link_id, period, f_d, n, f_p, s."""
    df = episodes.where((F.col("P") > 0) & (F.col("DC") < S.DEMO_DOC_MAX - 0.01)).join(params.select("link_id", "period", *PARAMETERS), ["link_id", "period"])
    p, v, cut = F.col("P"), F.col("v_t2"), F.col("cutoff")
    df = df.withColumn("p_hat", F.col("f_d") * F.pow("DC", "n")).withColumn("m_hat", F.col("f_p") * F.pow("P", "s"))
    v_hat = cut / (1 + F.col("m_hat"))
    t0, t3 = F.col("t2") - 0.5 * F.col("p_hat"), F.col("t2") + 0.5 * F.col("p_hat")
    out = df.groupBy("period").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.countDistinct("link_id").alias("n_links"), F.round(metrics.r2_floored(p, F.col("p_hat")), 3).alias("step1_r2"), F.round(metrics.r2_floored(cut / v - 1, F.col("m_hat")), 3).alias("step2_r2"),
        F.round(metrics.mae(p, F.col("p_hat")), 2).alias("p_mae_h"), F.round(metrics.mape(p, F.col("p_hat")), 1).alias("p_mape"), F.round(metrics.mae(v, v_hat), 1).alias("vt2_mae"), F.round(metrics.mape(v, v_hat), 1).alias("vt2_mape"),
        F.round(F.avg((F.abs(v - v_hat) <= S.DEMO_VT2_TOL).cast("double")) * 100, 1).alias("vt2_within"), F.round(metrics.mae(F.col("t0"), t0) * 60, 1).alias("t0_mae_min"), F.round(metrics.mae(F.col("t3"), t3) * 60, 1).alias("t3_mae_min"),
    )
    return out.where(F.col("n_episodes") >= least)


def series_quality(bins: DataFrame, average: DataFrame, least: int = 8) -> DataFrame:
    """Of each link: how well the smoothed average weekday fits the raw one, and how far single working days are from it
    (mean RMSE, mean R2, mean coefficient of variation of a bin)."""
    lo, hi = S.DEMO_WINDOW
    inside = (F.col("t_min") >= lo) & (F.col("t_min") < hi)
    avg = average.where(inside).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("link_id"))).where(F.col("n") >= least)
    avg = smoothed(avg).select("link_id", "t_min", F.col("speed").alias("raw"), "sm")
    fit = avg.groupBy("link_id").agg(F.round(metrics.r2(F.col("raw"), F.col("sm")), 3).alias("smooth_r2"), F.round(metrics.rmse(F.col("raw"), F.col("sm")), 2).alias("smooth_rmse"))
    days = bins.where(inside & (F.col("weekday") < 5)).join(avg.select("link_id", "t_min", "sm"), ["link_id", "t_min"], "left")
    each = days.groupBy("link_id", "date").agg(metrics.rmse(F.col("speed"), F.col("sm")).alias("rmse"), metrics.r2(F.col("speed"), F.col("sm")).alias("r2"))
    each = each.groupBy("link_id").agg(F.count(F.lit(1)).alias("n_weekdays"), F.round(F.avg("rmse"), 2).alias("day_rmse"), F.round(F.avg("r2"), 3).alias("day_r2"))
    spread = days.groupBy("link_id", "t_min").agg((F.stddev_samp("speed") / F.greatest(F.avg("speed"), F.lit(1.0))).alias("cv")).groupBy("link_id").agg(F.round(F.avg("cv"), 3).alias("day_cv"))
    return fit.join(each, "link_id").join(spread, "link_id")


def quality_gates(calibration: DataFrame, series: DataFrame, diagrams: DataFrame | None = None) -> DataFrame:
    """(period, gate, value, threshold, passed) of the method's gates; diagrams: link_id, fd_r2, where flow was measured."""
    g = S.DEMO_GATES
    one = series.agg(F.round(F.percentile("smooth_r2", F.lit(0.5)), 3).alias("smooth"))
    df = calibration.crossJoin(one)  # one row
    rules = [("n_links", "n_links", g["min_n_links"], 1), ("step1_r2", "step1_r2", g["min_step1_r2"], 1), ("step2_r2", "step2_r2", g["min_step2_r2"], 1), ("p_mape", "p_mape", g["max_p_mape"], -1), ("vt2_mape", "vt2_mape", g["max_vt2_mape"], -1), ("vt2_within", "vt2_within", g["min_vt2_within"], 1), ("smooth_r2_median", "smooth", g["min_smooth_r2"], 1)]
    if diagrams is not None:
        df = df.crossJoin(diagrams.agg(F.round(F.percentile("fd_r2", F.lit(0.5)), 3).alias("fd")))  # one row
        rules.append(("fd_r2_median", "fd", g["min_fd_r2"], 1))
    rows = [F.struct(F.lit(name).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(x)).alias("threshold"), F.coalesce(F.col(c) * sign >= x * sign, F.lit(False)).alias("passed")) for name, c, x, sign in rules]
    return df.select("period", F.inline(F.array(*rows)))


def class_default(facility: str | None = None, area: str | None = None) -> dict[str, float]:
    return dict(S.DEMO_CLASSES.get((facility, area), S.DEMO_DEFAULT))


def queue_curve(episodes: DataFrame) -> DataFrame:
    """Speeds over the wide window in bins: down from the cutoff at t0 to the lowest speed at t2 and back at t3, smooth at
    all three, with ramps to the free-flow speed outside. episodes: keys, t0, t2, t3 (hours), v_low, cutoff, vf."""
    lo, hi = S.DEMO_WINDOW
    t, t0, t3, cut, vf = F.col("minute") / 60.0, F.col("t0"), F.col("t3"), F.col("cutoff"), F.col("vf")
    t2 = F.least(F.greatest(F.col("t2"), t0 + 1e-3), t3 - 1e-3)
    low = F.least(F.greatest(F.col("v_low"), F.lit(1.0)), cut)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    x = unit(F.when(t <= t2, (t - t0) / (t2 - t0)).otherwise((t3 - t) / (t3 - t2)))
    inside = cut - (cut - low) * smoothstep(x)
    before = vf - (vf - cut) * ((t - lo / 60) / F.greatest(F.lit(0.01), t0 - lo / 60))
    after = cut + (vf - cut) * ((t - t3) / F.greatest(F.lit(0.01), hi / 60 - t3))
    v = F.when((t >= t0) & (t <= t3), inside).when(t < t0, before).otherwise(after)
    return episodes.withColumn("minute", F.explode(F.sequence(F.lit(lo), F.lit(hi - S.DEMO_DT), F.lit(S.DEMO_DT)))).withColumn("model_speed", F.greatest(F.lit(0.0), F.least(v, vf)))


def period_accounting(profiles: DataFrame, diagrams: DataFrame, least_bins: int = 8) -> DataFrame:
    """One row for each period (NT outside of all): vehicle miles and hours of the average weekday inside the search window,
    hours at free flow, delay against free flow and against the speed at capacity, mean speed, and delay's share of the hours
    in per cent. Neither delay is negative. diagrams: link_id, vf, uc; links with fewer than ``least_bins`` bins have none."""
    lo, hi = S.DEMO_WINDOW
    df = profiles.where((F.col("t_min") >= lo) & (F.col("t_min") < hi) & F.col("flow_pl").isNotNull())
    df = df.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("link_id"))).where(F.col("n") >= least_bins).join(diagrams.select("link_id", "vf", "uc"), "link_id")
    vmt = F.col("flow_pl") * (S.DEMO_DT / 60) * F.col("lanes") * F.col("length")
    df = df.withColumns({"period": F.coalesce(_period(F.col("t_min")), F.lit("NT")), "vmt": vmt}).withColumns({"vht": F.col("vmt") / F.greatest("speed", F.lit(1.0)), "free": F.col("vmt") / F.col("vf"), "full": F.col("vmt") / F.col("uc")})
    over = lambda c: F.sum(F.greatest(F.col("vht") - F.col(c), F.lit(0.0)))
    out = df.groupBy("period").agg(F.sum("vmt").alias("vmt"), F.sum("vht").alias("vht"), F.sum("free").alias("vfftt"), over("free").alias("vdt"), over("full").alias("vcdt"))
    some = F.col("vht") > 0
    return out.withColumns({"avg_speed": F.when(some, F.col("vmt") / F.col("vht")).otherwise(0.0), "delay_share_pct": F.when(some, F.col("vdt") / F.col("vht") * 100).otherwise(0.0)})
