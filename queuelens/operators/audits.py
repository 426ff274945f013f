"""Audits of single episodes: measured triples with outlier flags, derived quantities against a diagram, predictions
against observations, and parameters of whole corridors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.functions import metrics
from queuelens.functions.traffic import clip_to_default, reliability, s3_flow
from queuelens.operators import priors, regressions
from queuelens.operators.discharge import mu_per_episode
from queuelens.operators.episodes import sliced
from queuelens.session import cut

EPISODE = ["sensor_uid", "date", "period"]
#: Prior of each queue parameter, and the weight of a prior in episodes.
PARAMETERS = ("Q_n", "Q_s", "Q_cd", "Q_cp", "Q_alpha", "Q_beta")


def measured_panel(episodes: DataFrame, qc: DataFrame, capacity: DataFrame) -> DataFrame:
    """Valid episodes with demand over capacity (hours), duration, lowest speed and discharge rate."""
    df = mu_per_episode(episodes.where("is_valid_for_mu"), qc).join(capacity.select("sensor_uid", "capacity_vphpl"), "sensor_uid", "left")
    hours = F.col("demand_veh") / F.greatest(F.col("capacity_vphpl"), F.lit(1e-3))
    return df.select(*EPISODE, "corridor", "P_min", (F.col("P_min") / 60).alias("P_hours"), F.col("min_speed_mph").alias("V_t2_mph"), "v_c_mph", "demand_veh", "capacity_vphpl", hours.alias("D_over_C_hours"), "mu_obs_vphpl")


def with_flags(panel: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Adds a flag for each physical rule (and those of ``more``), how many hold, and their names joined by ';'."""
    doc, mu, cap = F.col("D_over_C_hours"), F.col("mu_obs_vphpl"), F.coalesce("capacity_vphpl", F.lit(2000.0))
    rules = {
        "doc_high_P_zero": (doc > 1.0) & (F.col("P_min") < 15.0),
        "doc_low_P_high": (doc < 0.5) & (F.col("P_min") > 60.0),
        "mu_above_capacity": mu > 1.05 * cap,
        "mu_starved": (doc > 1.5) & (mu < 0.3 * cap),
        "vt2_above_vc": F.col("V_t2_mph") >= F.coalesce("v_c_mph", F.lit(50.0)),
        "vt2_too_low": F.col("V_t2_mph") < 5.0,
        **(more or {}),
    }
    df = panel.withColumns({f"flag_{k}": F.coalesce(c, F.lit(False)) for k, c in rules.items()})
    n = sum((F.col(f"flag_{k}").cast("int") for k in rules), F.lit(0))
    return df.withColumns({"outlier_n_flags": n, "is_outlier": n > 0, "outlier_reasons": F.concat_ws(";", *[F.when(F.col(f"flag_{k}"), k) for k in rules])})


def huber_line(points: DataFrame, x: str, y: str, epsilon: float = 1.35, alpha: float = 1e-4, rounds: int = 60) -> tuple[float, float, float] | None:
    """Slope, intercept and scale of the Huber regression with concomitant scale: sums of reweighted rows, one
    aggregation a round; None with fewer than eight points."""
    df = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    first = df.agg(F.count(F.lit(1)), F.regr_slope("y", "x"), F.regr_intercept("y", "x"), F.stddev_pop("y")).first()
    if first[0] < 8:
        return None
    n, a, b, s = first[0], first[1] or 0.0, first[2] or 0.0, first[3] or 1.0
    for _ in range(rounds):
        r = F.col("y") - a * F.col("x") - b
        inside = F.abs(r) <= epsilon * s
        w = F.when(inside, F.lit(1.0)).otherwise(epsilon * s / F.abs(r))
        m = df.select("x", "y", r.alias("r"), inside.alias("in"), w.alias("w")).agg(
            F.sum("w"), F.sum(F.col("w") * F.col("x")), F.sum(F.col("w") * F.col("x") * F.col("x")), F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("x") * F.col("y")), F.count_if(~F.col("in")), F.sum(F.when(F.col("in"), F.col("r") * F.col("r")).otherwise(0.0))
        ).first()
        sw, sx, sxx, sy, sxy, out, rss = m
        sxx += alpha * s
        det = sw * sxx - sx * sx
        new = ((sw * sxy - sx * sy) / det, (sxx * sy - sx * sxy) / det) if det > 0 else (a, b)
        scale = max((rss / max(n - out * epsilon**2, 1e-9)) ** 0.5, 1e-12)
        done = abs(new[0] - a) + abs(new[1] - b) + abs(scale - s) < 1e-9 * (1 + abs(a) + abs(b) + s)
        (a, b), s = new, scale
        if done:
            break
    return a, b, s


def with_all_flags(panel: DataFrame, k: float = 3.0, least: int = 8) -> DataFrame:
    """The six physical rules and three residual rules: where the residual of a Huber line (logarithms of duration on demand
    over capacity, discharge rate on it, logarithms of lowest speed on duration) is over k scaled MADs from 0. A rule whose
    pairs are fewer than ``least``, whose MAD is 0, or whose line diverges, flags nothing.

    The three lines are groups of one regression, so a round is one aggregation for all; their medians are two more. Lines
    come back to the panel as one row.
    """
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-6)))
    rules = {
        "huber_resid_doc_P": (log("D_over_C_hours"), log("P_hours")),
        "huber_resid_doc_mu": (F.col("D_over_C_hours"), F.col("mu_obs_vphpl")),
        "huber_resid_P_vt2": (log("P_hours"), log("V_t2_mph")),
    }
    panel = cut(panel)
    pairs = panel.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), x.alias("x"), y.alias("y")) for n, (x, y) in rules.items()]))).where("x is not null and y is not null")
    lines = regressions.huber_regressions(pairs, ("x",), "y", ("rule",), least=least).select("rule", F.col("coefs")[0].alias("slope"), "intercept")
    rest = cut(pairs.join(F.broadcast(lines), "rule").withColumn("r", F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")))  # three lines
    middle = rest.groupBy("rule").agg(F.percentile("r", F.lit(0.5)).alias("middle"))
    mad = rest.join(F.broadcast(middle), "rule").groupBy("rule").agg((F.percentile(F.abs(F.col("r") - F.col("middle")), F.lit(0.5)) * S.MAD_SCALE).alias("mad"))
    of = lambda n: F.max(F.when((F.col("rule") == n) & (F.col("mad") > 0), F.struct("slope", "intercept", "mad"))).alias(n)
    one = lines.join(mad, "rule").agg(*[of(n) for n in rules])
    more = {n: F.abs(y - F.col(f"{n}.slope") * x - F.col(f"{n}.intercept")) > k * F.col(f"{n}.mad") for n, (x, y) in rules.items()}
    return with_flags(panel.crossJoin(one), more).drop(*rules)  # one row


def audit(episodes: DataFrame, qc: DataFrame, diagrams: DataFrame, prior: str | dict | None = None) -> DataFrame:
    """Valid episodes with fitted critical speed and capacity, the discharge window's length, observed rate, mean speed,
    the rate that the prior's diagram gives at that speed, and their relative difference.

    diagrams: sensor_uid, v_c_fit_mph, capacity_vphpl, flow_synthetic. Windows meet their rows by an equi-join.
    """
    p = priors.resolve(prior)
    merged = sliced(qc.where((F.hour("datetime") >= 10) & (F.hour("datetime") < 20)), F.lit("MDPM"))
    rows = sliced(qc).unionByName(merged).select(*EPISODE, "idx", "flow_vph", "speed_mph_clean")
    valid = episodes.where("is_valid_for_mu")
    inside = rows.join(valid.select(*EPISODE, "discharge_start_idx", "discharge_end_idx"), EPISODE).where("idx between discharge_start_idx and discharge_end_idx")
    window = inside.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("discharge_n_intervals"), F.percentile("flow_vph", F.lit(0.5)).alias("mu_obs_vphpl"), F.avg("speed_mph_clean").alias("mean_speed"))
    df = valid.join(window, EPISODE, "left").join(diagrams, "sensor_uid", "left")
    check = s3_flow("mean_speed", p["vf_mph"], p["k_critical_vpm"], p["s3_m"], p["lane_capacity_vphpl"])
    synthetic = F.coalesce("flow_synthetic", F.lit(False))
    mu = F.col("mu_obs_vphpl")
    df = df.withColumn("mu_check_vphpl", check)
    return df.select(
        *EPISODE,
        "corridor",
        F.col("v_c_mph").alias("v_c_prior_mph"),
        F.col("v_c_fit_mph").alias("v_c_calibrated_mph"),
        F.when(synthetic, "user_prior_or_cbi_inverse").otherwise("fitted_from_data").alias("v_c_source"),
        F.lit(p["lane_capacity_vphpl"]).alias("capacity_prior_vphpl"),
        F.col("capacity_vphpl").alias("capacity_calibrated_vphpl"),
        F.when(synthetic, "cbi_inverse_prior").otherwise("fitted_from_data").alias("capacity_source"),
        "P_min",
        F.col("min_speed_mph").alias("v_t2_mph"),
        F.coalesce("discharge_n_intervals", F.lit(0)).alias("discharge_n_intervals"),
        (F.coalesce("discharge_n_intervals", F.lit(0)) * float(S.DT_MIN)).alias("discharge_duration_min"),
        "mu_obs_vphpl",
        "mu_check_vphpl",
        F.when(mu > 0, F.abs(mu - F.col("mu_check_vphpl")) / mu).alias("mu_consistency"),
        "t3_index",
    )


def interleaved(audited: DataFrame, most: int = 24) -> DataFrame:
    """The episodes to look at first: the longest of each period in turn, ``most`` of them at most."""
    turn = F.row_number().over(W.partitionBy("period").orderBy(F.desc("P_min"), "sensor_uid", "date"))
    return audited.withColumn("turn", turn).orderBy("turn", F.desc("P_min"), "period").limit(most)


def round_trip(predicted: DataFrame) -> DataFrame:
    """Errors of predicted duration and lowest speed, absolute and in per cent of the observed ones."""
    p, v = F.col("P_hours"), F.col("min_speed_mph")
    return predicted.withColumns(
        {
            "P_err_hours": F.col("P_hat") - p,
            "P_err_pct": F.when(p > 0, (F.col("P_hat") - p) / p * 100),
            "vt2_err_mph": F.col("vt2_hat") - v,
            "vt2_err_pct": F.when(v > 0, (F.col("vt2_hat") - v) / F.greatest(v, F.lit(1.0)) * 100),
        }
    )


def nearest_speeds(profile: DataFrame, qc: DataFrame, tolerance_h: float = S.DT_MIN / 60 + 1e-6) -> DataFrame:
    """Profile steps (episode keys, step, hour) with the observed speed nearest in time within the tolerance (ties: the
    earlier), of rows of the episode's sensor, date and period slice. Steps meet rows through 5-minute slots, their own
    and those beside it, so the join is an equi-join."""
    hour = F.hour("datetime") + F.minute("datetime") / 60.0
    merged = sliced(qc.where((F.hour("datetime") >= 10) & (F.hour("datetime") < 20)), F.lit("MDPM"))
    seen = sliced(qc).unionByName(merged).select(*EPISODE, hour.alias("at"), F.coalesce("speed_mph_clean", "speed_mph").alias("seen"))
    slot = lambda c: F.floor(c * 12 + 1e-6).cast("int")
    seen = seen.withColumn("slot", slot(F.col("at")))
    steps = profile.withColumn("slot", F.explode(F.array(*[slot(F.col("hour")) + i for i in (-2, -1, 0, 1, 2)])))
    met = steps.join(seen, [*EPISODE, "slot"], "left").withColumn("far", F.abs(F.col("at") - F.col("hour")))
    met = met.withColumn("far", F.when(F.col("far") <= tolerance_h, F.col("far")))
    best = F.min(F.when(F.col("far").isNotNull(), F.struct(F.round("far", 9).alias("far"), "at", "seen")))
    return met.groupBy(*EPISODE, "step").agg(F.first("td_speed_mph").alias("td_speed_mph"), best["seen"].alias("obs_speed_mph"))


def speed_errors(met: DataFrame, least: int = 3) -> DataFrame:
    """MAE, MAPE and RMSE of profiles against observed speeds over 1 mph, for episodes with ``least`` such steps."""
    use = (F.col("td_speed_mph").isNotNull()) & (F.col("obs_speed_mph") > 1.0)
    model, seen = F.when(use, F.col("td_speed_mph")), F.when(use, F.col("obs_speed_mph"))
    n = F.count(seen)
    some = lambda c: F.when(n >= least, c)
    return met.groupBy(*EPISODE).agg(some(metrics.mae(seen, model)).alias("v_t_MAE"), some(F.avg(F.abs(model - seen) / F.greatest(seen, F.lit(1.0))) * 100).alias("v_t_MAPE_pct"), some(metrics.rmse(seen, model)).alias("v_t_RMSE"), n.alias("v_t_n"))


def corridor_parameters(calibrated: DataFrame, flagged: DataFrame | None = None, k0: float = 5.0) -> DataFrame:
    """One row for each corridor, period and queue parameter: median, interquartile range, weight of the data n/(n+k0),
    the value shrunk to the prior, where it comes from, and counts of the episodes behind it.

    Episodes whose calibration isn't ok, and those flagged as outliers, are left out first. Parameters are stacked, so one
    aggregation serves all; fits.bootstrap_median has the medians' intervals.
    """
    df = calibrated.where("calibration_status = 'ok'")
    if flagged is not None:
        df = df.join(flagged.where("is_outlier").select(*EPISODE), EPISODE, "left_anti")
    stack = F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("value"), F.lit(float(S.FEASIBLE[p][0])).alias("prior")) for p in PARAMETERS]))
    df = df.select("corridor", "period", "sensor_uid", "date", stack.alias("s")).select("corridor", "period", "sensor_uid", "date", "s.*")
    n, alpha = F.count("value"), F.count("value") / (F.count("value") + k0)
    middle, prior = F.percentile("value", F.lit(0.5)), F.first("prior")
    quarters = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    out = df.groupBy("corridor", "period", "parameter").agg(
        F.count(F.lit(1)).alias("n_episodes_used"), F.countDistinct("sensor_uid").alias("n_distinct_sensors"), F.countDistinct("date").alias("n_distinct_dates"), n.alias("n_values"), middle.alias("median"),
        F.when(n >= 4, quarters[1] - quarters[0]).alias("iqr"), alpha.alias("alpha_shrinkage"), F.coalesce(alpha * middle + (1 - alpha) * prior, prior).alias("raw"), prior.alias("prior"),
    )
    shrunk = F.lit(None).cast("double")
    for p in PARAMETERS:
        shrunk = F.when(F.col("parameter") == p, clip_to_default(p, F.col("raw"))).otherwise(shrunk)
    source = F.when(F.col("alpha_shrinkage") >= 0.7, "self").when(F.col("alpha_shrinkage") > 0, "shrunk").otherwise("prior_only")
    return out.withColumns({"shrunk": shrunk, "source": source, "reliability_class": reliability("n_episodes_used"), "flag_low_sample": F.col("n_episodes_used") < S.RELIABLE_FROM["low"]}).drop("raw")
