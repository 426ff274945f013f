"""Bottleneck ranking: class of each valid episode, score of each sensor and period, corridor summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.operators.quality_control import places


def with_class(episodes: DataFrame, dt_min: float = S.DT_MIN) -> DataFrame:
    """Adds bottleneck_class to valid episodes (with their road position ``pos``).

    queued_passive: an episode downstream overlaps in time; else spillback_source: one upstream does; else
    active_bottleneck; isolated_uncertain: neither neighbour has any episode. Neighbours meet by an equi-join on corridor,
    date and position with the overlap as a range condition.
    """
    start = F.lit(0)
    for period, (h, _) in S.SLICES.items():
        start = F.when(F.col("period") == period, h * 60).otherwise(start)
    eps = episodes.withColumns({"t0_abs": start + F.col("t0_index") * int(dt_min), "t3_abs": start + F.col("t3_index") * int(dt_min)})
    with_valid = eps.select("corridor", F.col("pos").alias("npos")).distinct()
    for name, step in (("down", 1), ("up", -1)):
        near = with_valid.select("corridor", (F.col("npos") - step).alias("pos"), F.lit(True).alias(f"{name}_known"))
        eps = eps.join(near, ["corridor", "pos"], "left")
        there = eps.select("corridor", "date", (F.col("pos") - step).alias("pos"), F.col("t0_abs").alias("a"), F.col("t3_abs").alias("b"))
        met = eps.join(there, ["corridor", "date", "pos"]).where("not (t3_abs < a or b < t0_abs)")
        met = met.select("sensor_uid", "date", "period").distinct().withColumn(f"{name}_met", F.lit(True))
        eps = eps.join(met, ["sensor_uid", "date", "period"], "left")
    cls = (
        F.when(F.col("regime") == "event", "incident_related")
        .when(F.col("down_known").isNull() & F.col("up_known").isNull(), "isolated_uncertain")
        .when(F.col("down_met"), "queued_passive")
        .when(F.col("up_met"), "spillback_source")
        .otherwise("active_bottleneck")
    )
    return eps.withColumn("bottleneck_class", cls).drop("down_known", "up_known", "down_met", "up_met")


def rank(episodes: DataFrame, sensors: DataFrame | None = None, dt_min: float = S.DT_MIN) -> DataFrame:
    """One row for each sensor and period: frequency, median duration, severity, score, most frequent class, ranks
    within the corridor. Road positions are the order of (road_order, sensor) among all of the corridor's sensors, idle
    ones too, so that one of these between two queues keeps them apart; by default, all sensors that have episodes, valid
    or not."""
    valid = episodes.where("is_valid_for_mu")
    pos = places(episodes if sensors is None else sensors).select("corridor", "sensor_uid", F.col("place").alias("pos"))
    classed = with_class(valid.join(pos, ["corridor", "sensor_uid"]), dt_min)
    days = valid.groupBy("corridor").agg(F.countDistinct("date").alias("n_days_window"))
    mid = lambda c: F.percentile(c, F.lit(0.5))
    hours = F.greatest(F.col("P_min") / 60, F.lit(1e-6))
    grouped = classed.groupBy("corridor", "sensor_uid", "period").agg(
        F.count(F.lit(1)).alias("n_valid_episodes"),
        mid(F.greatest(1 - F.col("min_speed_mph") / F.col("v_c_mph"), F.lit(0.0))).alias("sev"),
        (mid("P_min") / 60).alias("dur"),
        mid("min_speed_mph").alias("vt2"),
        mid(F.col("demand_veh") / hours).alias("dem"),
        F.mode("bottleneck_class", True).alias("bottleneck_class"),
    )
    freq = F.col("n_valid_episodes") / F.greatest(F.col("n_days_window"), F.lit(1))
    out = grouped.join(days, "corridor").select(
        "corridor",
        "sensor_uid",
        "period",
        "n_valid_episodes",
        "n_days_window",
        F.bround(freq, 3).alias("freq_episodes_per_day"),
        F.bround("dur", 2).alias("median_P_hours"),
        F.bround("vt2", 1).alias("median_v_t2_mph"),
        F.bround("sev", 3).alias("severity"),
        F.bround(freq * F.col("dur") * F.col("sev"), 4).alias("CBI_score"),
        F.bround(freq * F.col("dur") * F.col("sev") * F.col("dem"), 1).alias("delay_proxy_veh_h_per_lane_day"),
        "bottleneck_class",
    )
    by_score = W.partitionBy("corridor").orderBy(F.desc("CBI_score"), "sensor_uid", "period")
    by_delay = W.partitionBy("corridor").orderBy(F.desc_nulls_last("delay_proxy_veh_h_per_lane_day"))
    return out.withColumn("rank_in_corridor", F.row_number().over(by_score)).withColumn(
        "rank_by_delay", F.when(F.col("delay_proxy_veh_h_per_lane_day").isNotNull(), F.rank().over(by_delay))
    )


def corridor_summary(ranking: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("bottleneck_class") == c)
    return ranking.groupBy("corridor", "period").agg(
        F.count(F.lit(1)).alias("n_ranked_sensor_periods"),
        F.bround(F.sum("CBI_score"), 4).alias("total_CBI_score"),
        F.min_by("sensor_uid", "rank_in_corridor").alias("top_sensor"),
        F.min_by("CBI_score", "rank_in_corridor").alias("top_score"),
        n("active_bottleneck").alias("n_active"),
        n("spillback_source").alias("n_spillback"),
        n("queued_passive").alias("n_passive"),
        n("incident_related").alias("n_incident"),
    )
