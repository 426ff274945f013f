"""Flow over time from modelled speeds, under the demand that was counted; emissions; whole-day models by period.

Rows of an episode or link have its keys, t_min, speed, vf and the demand of the whole (vehicles a lane).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.functions.traffic import predict_vt2, smoothstep
from queuelens.operators.weekday import _power, bounded_fit, smoothed


def shape(speed: Column, vf: Column, m: float = 6.0, form: str = "s3") -> Column:
    """Flow over its density scale: 0 at speed 0 and at the free-flow speed."""
    v = F.least(F.greatest(speed, F.lit(1e-6)), vf)
    if form == "greenshields":
        return v * (1 - v / vf)
    return v * F.pow(F.greatest(F.pow(vf / v, F.lit(m / 2)) - 1, F.lit(0.0)), F.lit(1 / m))


def conserving_flow(rows: DataFrame, keys: tuple[str, ...], dt_h: float = S.DEMO_DT / 60, m: float = 6.0, form: str = "s3") -> DataFrame:
    """Adds theta and q = theta * shape(speed), whose sum over a group is its demand; 0 where all shapes are."""
    w = W.partitionBy(*keys)
    df = rows.withColumn("_g", shape(F.col("speed"), F.col("vf"), m, form))
    total = F.sum("_g").over(w)
    df = df.withColumn("theta", F.when(total > 0, F.col("demand") / (dt_h * total)).otherwise(0.0))
    return df.withColumn("q", F.col("theta") * F.col("_g")).drop("_g")


def corridor_flow(rows: DataFrame, keys: tuple[str, ...], corridor: str = "corridor", dt_h: float = S.DEMO_DT / 60, m: float = 6.0, form: str = "s3", steps: int = 60) -> DataFrame:
    """One density scale for a corridor, and for each group the additive slack that makes its flows, within 0 and the
    capacity at that scale, sum to its demand. Adds theta, slack, deviation (slack over the mean flow) and q.

    The clipped sum grows with the slack, so halving an interval finds it: a fold over the group's own few bins.
    """
    g = W.partitionBy(*keys)
    df = rows.withColumn("_g", shape(F.col("speed"), F.col("vf"), m, form)).withColumn("_share", F.col("demand") / F.count(F.lit(1)).over(g))
    scale = df.groupBy(corridor).agg((F.sum("_share") / F.greatest(dt_h * F.sum("_g"), F.lit(1e-9))).alias("theta"))
    peak = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: shape(1e-6 + i / 399.0 * (F.col("vf") - 1e-6), F.col("vf"), m, form)))
    each = df.groupBy(corridor, *keys).agg(F.collect_list("_g").alias("gs"), F.first("demand").alias("demand"), F.first("vf").alias("vf")).join(scale, corridor)
    each = each.withColumns({"cap": F.col("theta") * peak, "flows": F.transform("gs", lambda x: x * F.col("theta"))})

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        total = F.aggregate("flows", F.lit(0.0), lambda a, x: a + F.least(F.greatest(x + mid, F.lit(0.0)), F.col("cap")))
        low = total < F.col("demand") / dt_h
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct((-F.col("cap")).alias("lo"), F.col("cap").alias("hi")), halve)
    each = each.withColumn("slack", (found["lo"] + found["hi"]) / 2)
    mean = F.aggregate("flows", F.lit(0.0), lambda a, x: a + x) / F.size("flows")
    solved = each.select(corridor, *keys, "theta", "slack", "cap", (F.abs("slack") / F.greatest(mean, F.lit(1e-6))).alias("deviation"))
    out = df.join(solved, [corridor, *keys])
    return out.withColumn("q", F.least(F.greatest(F.col("theta") * F.col("_g") + F.col("slack"), F.lit(0.0)), F.col("cap"))).drop("_g", "_share", "cap")


#: Coefficients of gallons a mile by speed, from the constant up; the speeds and the gallons between which the
#: curve holds; grams of a gallon.
FUEL, FUEL_SPEEDS, FUEL_RANGE, GALLON_G = (0.080, -0.0022, 0.0000235), (3.0, 80.0), (0.02, 0.20), 8887.0


def co2_grams_per_mile(speed: Column) -> Column:
    """A steady-state fuel curve times the grams of a gallon; least near 47 mph."""
    v = F.least(F.greatest(speed, F.lit(FUEL_SPEEDS[0])), F.lit(FUEL_SPEEDS[1]))
    gallons = FUEL[0] + FUEL[1] * v + FUEL[2] * v * v
    return F.least(F.greatest(gallons, F.lit(FUEL_RANGE[0])), F.lit(FUEL_RANGE[1])) * GALLON_G


def queue_speeds(episodes: DataFrame) -> DataFrame:
    """The symmetric queue's speeds over the wide window: from the cutoff at t0 down to the calibrated lowest speed half
    way and back at t3, with ramps to free flow. episodes: t0, t3 (hours), DC, f_p, s, cutoff, vf, length, cap."""
    lo, hi = S.DEMO_WINDOW
    p = F.greatest(F.col("t3") - F.col("t0"), F.lit(0.1))
    df = episodes.withColumn("_p", p).withColumn("v_low", predict_vt2("cutoff", "f_p", "_p", "s"))
    df = df.withColumn("_mu", F.greatest(F.least(F.col("cap"), F.col("DC") * F.col("cap") / F.col("_p")), F.lit(1e-3)))
    free = F.col("length") / F.col("cutoff")
    df = df.withColumn("_gamma", 64 * F.greatest(F.col("length") / F.col("v_low") - free, F.lit(0.0)) * F.col("_mu") / F.pow("_p", F.lit(4.0)))
    df = df.withColumn("minute", F.explode(F.sequence(F.lit(lo), F.lit(hi - S.DEMO_DT), F.lit(S.DEMO_DT))))
    t, t0, t3, cut, vf = F.col("minute") / 60.0, F.col("t0"), F.col("t3"), F.col("cutoff"), F.col("vf")
    queue = 0.25 * F.col("_gamma") * (t - t0) * (t - t0) * (t - t3) * (t - t3)
    v = F.when((t >= t0) & (t <= t3), F.col("length") / (queue / F.col("_mu") + free))
    v = v.when(t < t0, vf - (vf - cut) * ((t - lo / 60) / F.greatest(F.lit(0.01), t0 - lo / 60))).otherwise(cut + (vf - cut) * ((t - t3) / F.greatest(F.lit(0.01), hi / 60 - t3)))
    return df.withColumn("model_speed", F.greatest(F.lit(0.0), F.least(v, vf))).drop("_p", "_mu", "_gamma")


def _windowed(profiles: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Smoothed profiles in the wide window, each row with its period: the first and the last reach to the window's ends."""
    lo, hi = S.DEMO_WINDOW
    names = list(S.DEMO_PERIODS)
    period = F.lit(names[-1])
    for name in names[-2::-1]:
        period = F.when(F.col("t_min") < S.DEMO_PERIODS[name][1], name).otherwise(period)
    rows = smoothed(profiles.where((F.col("t_min") >= lo) & (F.col("t_min") < hi)))
    return rows.join(cutoffs.select("link_id", "cutoff"), "link_id").withColumn("period", period)


def _troughs(rows: DataFrame) -> DataFrame:
    """Of each link and period: hours below the cutoff, lowest speed and its time, last speed and the period's bins."""
    low = F.col("sm") < F.col("cutoff")
    return rows.groupBy("link_id", "period").agg(
        (F.count_if(low) * (S.DEMO_DT / 60)).alias("P"), F.min("sm").alias("least"), F.min_by("t_min", F.struct("sm", "t_min")).alias("at"), F.max_by("sm", "t_min").alias("last"), F.max("t_min").alias("end"), F.first("cutoff").alias("cutoff"), F.count(F.lit(1)).alias("n")
    )


def calibrate_periods(profiles: DataFrame, cutoffs: DataFrame, default: dict[str, float] | None = None, least: int = 4) -> DataFrame:
    """period, f_p, s: magnitude = f_p P^s across the links that are congested in the period, by a bounded fit; the
    default where fewer than ``least`` are. A task sees one number pair a link."""
    d = default or S.DEMO_DEFAULT
    lo, hi = S.DEMO_BOUNDS
    points = _troughs(_windowed(profiles, cutoffs)).where("n >= 3 and P > 0 and least > 0").withColumn("mag", F.greatest(F.col("cutoff") / F.col("least") - 1, F.lit(0.0)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (d["f_p"], d["s"]) if len(pdf) < least else bounded_fit(_power, pdf.P.to_numpy(float), pdf.mag.to_numpy(float), (1.0, 1.0), (lo, lo), (hi, hi))
        return pd.DataFrame([(pdf.period.iloc[0], float(a), float(b))], columns=["period", "f_p", "s"])

    found = points.select("period", "P", "mag").groupBy("period").applyInPandas(fit, "period string, f_p double, s double")
    every = points.sparkSession.createDataFrame([(p,) for p in S.DEMO_PERIODS], "period string")
    return every.join(found, "period", "left").select("period", F.coalesce("f_p", F.lit(d["f_p"])).alias("f_p"), F.coalesce("s", F.lit(d["s"])).alias("s"))


def whole_day(profiles: DataFrame, cutoffs: DataFrame, params: DataFrame) -> DataFrame:
    """Adds model_speed: each period's trough at its observed time and its predicted depth, joined smoothly to the observed
    speeds at the periods' ends, never over the free-flow speed (the profile's 99th percentile).

    Anchors join the bins in one window; between two of them the model follows a smooth step.
    """
    rows = _windowed(profiles, cutoffs)
    link = W.partitionBy("link_id")
    rows = rows.withColumn("ff", F.percentile("speed", F.lit(0.99)).over(link))
    ff = rows.groupBy("link_id").agg(F.first("ff").alias("ff"), F.min("t_min").alias("first"), F.max("t_min").alias("final"), F.min_by("sm", "t_min").alias("first_v"), F.max_by("sm", "t_min").alias("final_v"))
    trough = _troughs(rows).join(ff, "link_id").join(params, "period")
    trough = trough.withColumn("next", F.least(F.col("final"), F.col("end") + S.DEMO_DT))
    a = lambda t, v, o: F.struct(t.cast("int").alias("t"), v.alias("v"), F.lit(o).alias("o"))
    dip = F.when(F.col("least") < F.col("cutoff"), a(F.col("at"), predict_vt2("cutoff", "f_p", "P", "s"), 1))
    anchors = trough.select("link_id", F.explode(F.array_compact(F.array(dip, a(F.col("next"), F.least("last", "ff"), 2)))).alias("a"))
    ends = ff.select("link_id", F.explode(F.array(a(F.col("first"), F.least("first_v", "ff"), 0), a(F.col("final"), F.least("final_v", "ff"), 3))).alias("a"))
    anchors = anchors.unionByName(ends).groupBy("link_id", F.col("a.t").alias("t_min")).agg(F.min_by("a.v", F.struct("a.v", "a.o")).alias("anchor"))
    met = rows.join(anchors, ["link_id", "t_min"], "left")
    day = link.orderBy("t_min")
    mark = F.when(F.col("anchor").isNotNull(), F.struct("t_min", "anchor"))
    met = met.withColumns({"_b": F.last(mark, True).over(day.rowsBetween(W.unboundedPreceding, 0)), "_a": F.first(mark, True).over(day.rowsBetween(0, W.unboundedFollowing))})
    x = (F.col("t_min") - F.col("_b.t_min")) / F.greatest(F.col("_a.t_min") - F.col("_b.t_min"), F.lit(1))
    v = F.col("_b.anchor") + (F.col("_a.anchor") - F.col("_b.anchor")) * smoothstep(x)
    return met.withColumn("model_speed", F.least(F.greatest(v, F.lit(1.0)), F.col("ff"))).drop("_a", "_b", "anchor")
