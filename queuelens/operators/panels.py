"""Sensor statistics, regular grids, panels, residuals and agreement of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.session import cut


def free_flow(states: DataFrame, p: float = 0.95, least: int = 200) -> DataFrame:
    """The percentile of positive speeds; null with fewer than ``least`` of them."""
    v = F.when(F.col("speed_mph") > 0, F.col("speed_mph"))
    return states.groupBy("sensor_uid").agg(F.count(v).alias("n"), F.percentile(v, F.lit(p)).alias("v")).select("sensor_uid", "n", F.when(F.col("n") >= least, F.col("v")).alias("v_f_mph"))


def observed_share(states: DataFrame, bins_per_day: int = 288, lane_flow: float = 1900.0) -> DataFrame:
    """Share of a sensor's bins that are present on its days, and lanes by the 99th percentile of its total flow."""
    days = F.countDistinct(F.to_date("datetime"))
    lanes = F.bround(F.percentile(F.col("flow_vph") * F.col("lanes"), F.lit(0.99)) / lane_flow, 0)
    return states.groupBy("sensor_uid").agg(
        F.count(F.lit(1)).alias("n_bins"), days.alias("n_days"), F.round(F.count(F.lit(1)) / (days * float(bins_per_day)), 6).alias("observed_frac"), F.least(F.greatest(lanes, F.lit(1.0)), F.lit(8.0)).cast("int").alias("est_lanes")
    )


def well_observed(states: DataFrame, least: float = 0.6, bins_per_day: int = 288) -> DataFrame:
    keep = observed_share(states, bins_per_day).where(F.col("observed_frac") >= least).select("sensor_uid")
    return states.join(keep, "sensor_uid", "left_semi")


def corridor_panel(states: DataFrame, positions: list[float] | None = None, value: str = "speed_mph", most: int = 10_000) -> DataFrame:
    """Time by road position: columns s0, s1, ... for the positions in ascending order, whole or not. By default all that
    occur, which a pass looks for; more than ``most`` columns raise an error rather than drop any."""
    if positions is None:
        positions = [r[0] for r in states.select("road_order").where("road_order is not null").distinct().sort("road_order").limit(most + 1).collect()]
        if len(positions) > most:
            raise ValueError(f"more than {most} road positions; give those that are wanted")
    at = lambda x: F.max(F.when(F.col("road_order") == x, F.col(value)))
    return states.groupBy("corridor", "datetime").agg(F.count(F.lit(1)).alias("_n"), *[at(x).alias(f"s{i}") for i, x in enumerate(positions)]).drop("_n")


def grid_filled(states: DataFrame, step: str = "1 hour") -> DataFrame:
    """Mean speeds on a regular grid from each sensor's first to its last bin; gaps are interpolated in time, ends held."""
    hourly = cut(states.groupBy("sensor_uid", F.window("datetime", step)["start"].alias("datetime")).agg(F.avg("speed_mph").alias("v")))
    grid = hourly.groupBy("sensor_uid").agg(F.min("datetime").alias("a"), F.max("datetime").alias("b")).select("sensor_uid", F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("datetime"))
    df = grid.join(hourly, ["sensor_uid", "datetime"], "left").withColumn("known", F.when(F.col("v").isNotNull(), F.unix_timestamp(F.col("datetime").cast("timestamp"))))
    back = W.partitionBy("sensor_uid").orderBy("datetime").rowsBetween(W.unboundedPreceding, 0)
    # backwards: a frame that begins at each row is summed up again for every one of them
    ahead = W.partitionBy("sensor_uid").orderBy(F.desc("datetime")).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns(
        {"v0": F.last("v", True).over(back), "t0": F.last("known", True).over(back), "v1": F.last("v", True).over(ahead), "t1": F.last("known", True).over(ahead), "t": F.unix_timestamp(F.col("datetime").cast("timestamp"))}
    )
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / F.when(F.col("t1") != F.col("t0"), F.col("t1") - F.col("t0"))
    return df.select("sensor_uid", "datetime", F.col("v").isNull().alias("filled"), F.coalesce("v", between, "v1", "v0").alias("speed_mph"))


def flow_residual(states: DataFrame) -> DataFrame:
    """Differences of mean flow between neighbouring stations of a corridor, by hour."""
    mean = states.groupBy("corridor", "sensor_uid", "road_order", F.hour("datetime").alias("hour")).agg(F.avg("flow_vph").alias("q"))
    diff = F.col("q") - F.lag("q").over(W.partitionBy("corridor", "hour").orderBy("road_order", "sensor_uid"))
    return mean.withColumn("diff", diff).groupBy("corridor", "hour").agg(F.count("diff").alias("n"), F.avg("diff").alias("mean_residual"), F.percentile(F.abs("diff"), F.lit(0.95)).alias("p95_abs"))


def recurrent_deviation(states: DataFrame) -> DataFrame:
    """How far each day's hourly speeds are from the mean day: the Frobenius norm over sensors and hours."""
    cells = states.groupBy("sensor_uid", F.to_date("datetime").alias("day"), F.hour("datetime").alias("hour")).agg(F.avg("speed_mph").alias("v"))
    d = F.col("v") - F.avg("v").over(W.partitionBy("sensor_uid", "hour"))
    return cells.withColumn("d", d).groupBy(F.date_format("day", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n_cells"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("frobenius"))


def rank_agreement(scores: DataFrame, a: str, b: str, least: int = 5) -> DataFrame:
    """Spearman's correlation (average ranks) and top-5 overlap of two scores in each corridor, and the gate on them."""

    def average_rank(c):
        return F.rank().over(W.partitionBy("corridor").orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("corridor", c)) - 1) / 2.0

    place = lambda c: F.row_number().over(W.partitionBy("corridor").orderBy(F.desc_nulls_last(c), "sensor_uid"))
    r = scores.withColumns({"ra": average_rank(a), "rb": average_rank(b), "pa": place(a), "pb": place(b)})
    out = r.groupBy("corridor").agg(F.count(F.lit(1)).alias("n_common"), F.round(F.corr("ra", "rb"), 6).alias("spearman"), F.count_if((F.col("pa") <= 5) & (F.col("pb") <= 5)).alias("top5_overlap"))
    gate = F.when(F.col("n_common") < least, "N/A").when(F.col("spearman") >= 0.7, "PASS").when(F.col("spearman") >= 0.5, "REVIEW").otherwise("FAIL")
    return out.withColumn("gate", gate)
