"""Priors of the S-shaped diagram: presets, and priors calibrated on observed speeds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.functions import metrics


def resolve(prior: str | dict | None = None) -> dict[str, float]:
    """A preset by its name, a dict over the default preset, or the default."""
    if prior is None or isinstance(prior, str):
        name = prior or "cbi_default"
        if name not in S.S3_PRIORS:
            raise ValueError(f"no such preset: {name}; there are {sorted(S.S3_PRIORS)}")
        return dict(S.S3_PRIORS[name])
    if isinstance(prior, dict):
        return {**S.S3_PRIORS["cbi_default"], **prior}
    raise TypeError("a prior is a preset's name, a dict or None")


def calibrated(states: DataFrame, prior: str | dict | None = None, rederive: bool = False, ratio: float = 0.7, percentile: float = 95.0, least: int = 200) -> DataFrame:
    """Each sensor's prior: the free-flow speed is the percentile of its positive speeds from ``least`` of them on; with
    ``rederive``, critical density and shape follow from the critical speed ratio * vf. ``changes`` names what was done."""
    base = resolve(prior)
    v = F.when(F.col("speed_mph") > 0, F.col("speed_mph"))
    df = states.groupBy("sensor_uid").agg(F.when(F.count(v) >= least, F.percentile(v, F.lit(percentile / 100))).alias("seen"))
    df = df.withColumn("vf_mph", F.coalesce("seen", F.lit(base["vf_mph"])))
    vf, vc = F.col("vf_mph"), ratio * F.col("vf_mph")
    again = F.lit(rederive) & (vf > 1) & (vc > 1) & (vf > vc)
    notes = (F.when(F.col("seen").isNotNull(), "vf calibrated"), F.when(again, "k_c and m rederived"))
    return df.select(
        "sensor_uid",
        "vf_mph",
        F.when(again, base["lane_capacity_vphpl"] / vc).otherwise(base["k_critical_vpm"]).alias("k_critical_vpm"),
        F.when(again, 2 * math.log(2) / F.log(vf / vc)).otherwise(base["s3_m"]).alias("s3_m"),
        F.lit(base["lane_capacity_vphpl"]).alias("lane_capacity_vphpl"),
        F.concat_ws(" | ", *notes).alias("changes"),
    )


def observed_diagrams(states: DataFrame, ratio: float = 0.7, free: float = 0.95, top: float = 0.98) -> DataFrame:
    """Each sensor's S-shaped diagram by its own rows: free-flow speed (a percentile of positive speeds), critical speed as a
    share of it, capacity (a percentile of flows), and the critical density and shape that follow from them; r2 of the speeds
    against it at their densities. One aggregation, and one more for r2."""
    v = F.when(F.col("speed_mph") > 0, F.col("speed_mph"))
    d = states.groupBy("sensor_uid").agg(F.percentile(v, F.lit(free)).alias("v_f_mph"), F.percentile("flow_vph", F.lit(top)).alias("capacity_vphpl")).where("v_f_mph is not null")
    d = d.withColumn("v_c_mph", ratio * F.col("v_f_mph"))
    d = d.withColumns({"k_critical_vpm": F.col("capacity_vphpl") / F.col("v_c_mph"), "s3_m": F.lit(2 * math.log(2) / -math.log(ratio))})
    model = F.col("v_f_mph") / F.pow(1 + F.pow(F.col("density_vpm") / F.col("k_critical_vpm"), F.col("s3_m")), 2 / F.col("s3_m"))
    rows = states.where("speed_mph > 0 and density_vpm > 0").select("sensor_uid", "speed_mph", "density_vpm").join(d.select("sensor_uid", "v_f_mph", "k_critical_vpm", "s3_m"), "sensor_uid")
    return d.join(rows.groupBy("sensor_uid").agg(metrics.r2(F.col("speed_mph"), model).alias("r2")), "sensor_uid", "left")
