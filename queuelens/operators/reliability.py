"""Travel-time reliability and vehicle-hours of delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens import schemas as S


def epochs(states: DataFrame, speed: str = "speed_mph") -> DataFrame:
    """15-minute mean speeds above 1 mph as travel times in seconds."""
    bins = states.groupBy("sensor_uid", F.window("datetime", "15 minutes")["start"].alias("epoch")).agg(F.avg(speed).alias("speed"), F.min("length_mi").alias("length_mi"))
    return bins.where("speed > 1 and length_mi is not null").withColumns({"tt_s": F.col("length_mi") / F.col("speed") * 3600, "hour": F.hour("epoch"), "weekday": F.weekday("epoch") < 5})


def travel_time_ratios(ep: DataFrame, periods: dict, high: float, name: str) -> DataFrame:
    """p50, the high percentile and their ratio for each sensor and period with at least eight epochs. An epoch counts in
    every period that covers it: an array of labels, exploded."""
    labels = []
    for label, (weekday, a, b) in periods.items():
        hours = (F.col("hour") >= a) & (F.col("hour") < b) if a < b else (F.col("hour") >= a) | (F.col("hour") < b)
        labels.append(F.when(hours if weekday is None else hours & (F.col("weekday") == weekday), label))
    rows = ep.withColumn("period", F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())))
    out = rows.groupBy("sensor_uid", "period").agg(F.percentile("tt_s", F.array(F.lit(0.5), F.lit(high))).alias("p"), F.count(F.lit(1)).alias("n_epochs")).where(F.col("n_epochs") >= S.PM3_MIN_EPOCHS)
    lo, hi = F.col("p")[0], F.col("p")[1]
    return out.select("sensor_uid", "period", F.bround(lo, 1).alias("p50_tt_s"), F.bround(hi, 1).alias(f"p{round(100 * high)}_tt_s"), F.bround(hi / F.greatest(lo, F.lit(1e-9)), 3).alias(name), "n_epochs")


def lottr(states: DataFrame) -> DataFrame:
    return travel_time_ratios(epochs(states), S.LOTTR_PERIODS, 0.8, "lottr").withColumn("reliable", F.col("lottr") < S.LOTTR_RELIABLE_BELOW)


def tttr(states: DataFrame, truck_states: DataFrame | None = None) -> DataFrame:
    basis = "all_vehicle_proxy" if truck_states is None else "truck_probe"
    return travel_time_ratios(epochs(states if truck_states is None else truck_states), S.TTTR_PERIODS, 0.95, "tttr").withColumn("basis", F.lit(basis))


def tttr_index(ratios: DataFrame) -> DataFrame:
    return ratios.groupBy("sensor_uid").agg(F.max("tttr").alias("tttr_index"))


def vehicle_hours_of_delay(states: DataFrame, ref_speed: float | None = None, speed: str = "speed_mph", dt_min: float = S.DT_MIN) -> DataFrame:
    """vhd for each sensor and date against the sensor's 95th percentile speed, or a fixed one.

    Refuses (raises) synthetic flow, frames without measured volume, and frames in which no sensor has its geometry:
    modelled volume must not be turned into delay. One aggregation decides all three.
    """
    known = F.col(speed).isNotNull() & F.col("flow_vph").isNotNull()
    geometry = F.col("lanes").isNotNull() & F.col("length_mi").isNotNull()
    gate = states.agg(F.bool_or("flow_synthetic"), F.bool_or("has_volume"), F.bool_or(known & geometry)).first()
    for refused, why in ((gate[0], "flow is synthetic"), (not gate[1], "no measured volume"), (not gate[2], "no sensor has lanes and length")):
        if refused:
            raise ValueError(f"vehicle-hours of delay refused: {why}")
    rows = states.where(known & geometry)
    ref = F.percentile(speed, F.lit(0.95)).over(W.partitionBy("sensor_uid")) if ref_speed is None else F.lit(float(ref_speed))
    late = F.col("length_mi") / F.greatest(F.col(speed), F.lit(3.0)) - F.col("length_mi") / F.greatest(F.col("ref"), F.lit(1.0))
    vehicles = F.col("flow_vph") * F.col("lanes") * dt_min / 60
    rows = rows.withColumn("ref", ref).withColumn("vhd", vehicles * F.greatest(late, F.lit(0.0)))
    return rows.groupBy("sensor_uid", F.date_format("datetime", "yyyy-MM-dd").alias("date")).agg(F.bround(F.sum("vhd"), 1).alias("vhd"))


def corridor_delay(per_sensor_day: DataFrame, usd_per_veh_h: float | None = None) -> DataFrame:
    """The corridor's delay of each date, and its median over dates (in dollars too, if a value of time is given)."""
    days = per_sensor_day.groupBy("date").agg(F.bround(F.sum("vhd"), 1).alias("veh_h"))
    median = days.agg(F.percentile("veh_h", F.lit(0.5)).alias("median_veh_h"))
    days = days.crossJoin(F.broadcast(median))  # one row
    return days if usd_per_veh_h is None else days.withColumn("usd_median", F.bround(F.col("median_veh_h") * usd_per_veh_h, 0))


def accounting(states: DataFrame, free_flow: float = 65.0, cutoff: float = 45.0, speed: str = "speed_mph", dt_min: float = S.DT_MIN) -> DataFrame:
    """Vehicle miles and hours, free-flow hours, delay and delay below the cutoff of each corridor and hour."""
    veh = F.col("flow_vph") * F.col("lanes") * dt_min / 60
    vmt, v = veh * F.col("length_mi"), F.greatest(F.col(speed), F.lit(1.0))
    rows = states.where(F.col(speed).isNotNull() & F.col("flow_vph").isNotNull()).withColumns({"vmt": vmt, "vht": vmt / v, "vfftt": vmt / free_flow, "slow": F.col(speed) < cutoff})
    delay = F.greatest(F.col("vht") - F.col("vfftt"), F.lit(0.0))
    return rows.groupBy("corridor", F.hour("datetime").alias("hour")).agg(
        F.sum("vmt").alias("vmt"), F.sum("vht").alias("vht"), F.sum("vfftt").alias("vfftt"), F.sum(delay).alias("vdt"), F.sum(F.when(F.col("slow"), delay).otherwise(0.0)).alias("vcdt"), (F.sum("vmt") / F.sum("vht")).alias("avg_speed")
    )
