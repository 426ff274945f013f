"""Stations day by day: the queue around the worst moment across missing bins, the laws that its days follow, and what sets
a day apart from the days of its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens import schemas as S

#: Critical over free-flow speed, percentiles of free-flow speed and capacity, least known bins of a day,
#: hours from which a day counts as congested, least days of a law.
CUTOFF, FREE, TOP, LEAST_BINS, CONGESTED_H, LEAST_DAYS = 0.7, 0.95, 0.98, 60, 0.25, 5


def day_grid(states: DataFrame, hours: tuple[int, int] = (11, 20), dt_min: int = S.DT_MIN) -> DataFrame:
    """sensor_uid, date, i, speed, flow for every bin of the window on every day that has a row in it; bins without one are
    there without values."""
    minute = F.hour("datetime") * 60 + F.minute("datetime")
    rows = states.where((F.hour("datetime") >= hours[0]) & (F.hour("datetime") < hours[1])).select("sensor_uid", F.date_format("datetime", "yyyy-MM-dd").alias("date"), F.floor((minute - hours[0] * 60) / dt_min).cast("int").alias("i"), "speed_mph", "flow_vph")
    seen = rows.groupBy("sensor_uid", "date", "i").agg(F.avg("speed_mph").alias("speed"), F.avg("flow_vph").alias("flow"))
    last = (hours[1] - hours[0]) * 60 // dt_min - 1
    grid = seen.select("sensor_uid", "date").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return grid.join(seen, ["sensor_uid", "date", "i"], "left")


def day_statistics(grid: DataFrame, bridge: int | None = None, dt_min: float = S.DT_MIN, least: int = LEAST_BINS) -> DataFrame:
    """One row for each sensor and day with ``least`` known speeds: P (hours), DC (hours), vt2, vbar, mu, and the sensor's
    v_co and capacity. A day that never falls below v_co has P = 0 and no more.

    From the lowest speed (the first of equal ones) the queue goes on over bins below v_co and over missing ones, to the
    first known bin at or above v_co on either side. With ``bridge``, a run of more missing bins than that ends it too: an
    island that tolerates gaps. Windows are over a day's bins.
    """
    v, day, order = F.col("speed"), W.partitionBy("sensor_uid", "date"), W.partitionBy("sensor_uid", "date").orderBy("i")
    own = grid.groupBy("sensor_uid").agg(F.percentile("speed", F.lit(FREE)).alias("vf"), F.percentile("flow", F.lit(TOP)).alias("cap")).select("sensor_uid", (CUTOFF * F.col("vf")).alias("v_co"), "cap")
    df = grid.join(own, "sensor_uid").withColumn("n_known", F.count(v).over(day)).where(F.col("n_known") >= least)
    df = df.withColumn("run", F.count(v).over(order))  # missing bins after the same known one
    gap = F.count_if(v.isNull()).over(W.partitionBy("sensor_uid", "date", "run"))
    ends = F.coalesce(v >= F.col("v_co"), F.lit(False))
    if bridge is not None:
        ends = ends | (v.isNull() & (gap > bridge))
    df = df.withColumns({"ends": ends, "t2": F.min(F.struct(v.isNull().alias("none"), v.alias("v"), F.col("i").alias("i"))).over(day)["i"]})
    i, t2 = F.col("i"), F.col("t2")
    df = df.withColumns({"before": F.max(F.when(F.col("ends") & (i < t2), i)).over(day), "after": F.min(F.when(F.col("ends") & (i > t2), i)).over(day)})
    inside = (i > F.coalesce("before", F.lit(-1))) & (i < F.coalesce("after", F.max("i").over(day) + 1))
    df = df.withColumn("inside", inside)
    out = df.groupBy("sensor_uid", "date", "v_co", "cap").agg(
        F.min("speed").alias("vt2"), F.count_if("inside").alias("bins"), F.sum(F.when(F.col("inside"), F.col("flow"))).alias("veh"), F.avg(F.when(F.col("inside"), v)).alias("vbar"),
        F.percentile(F.when(F.col("inside") & (i >= t2), F.col("flow")), F.lit(0.5)).alias("mu"),
    )
    low = F.col("vt2") < F.col("v_co")
    some = lambda c: F.when(low, c)
    return out.select("sensor_uid", "date", F.when(low, F.col("bins") * dt_min / 60).otherwise(0.0).alias("P"), some(F.coalesce("veh", F.lit(0.0)) * dt_min / 60 / F.nullif(F.col("cap"), F.lit(0.0))).alias("DC"), some(F.col("vt2")).alias("vt2"), some(F.col("vbar")).alias("vbar"), some(F.col("mu")).alias("mu"), "v_co", "cap")


def station_laws(days: DataFrame) -> DataFrame:
    """P = f_d DC^n and v_co / vt2 - 1 = f_p P^s over each sensor's congested days, in logarithms; theta, the mean speed in
    queues over the mean lowest speed; r2 of P."""
    d = days.where(F.col("P") > CONGESTED_H).withColumn("m", F.col("v_co") / F.col("vt2") - 1)
    use1, use2 = (F.col("DC") > 0) & (F.col("P") > 0), (F.col("P") > 0) & (F.col("m") > 0)
    ln = lambda use, c: F.when(use, F.log(c))
    n1, n2 = F.count_if(use1), F.count_if(use2)
    fit = d.groupBy("sensor_uid").agg(
        F.count(F.lit(1)).alias("n_days"), F.when(n1 >= LEAST_DAYS, F.exp(F.regr_intercept(ln(use1, F.col("P")), ln(use1, F.col("DC"))))).alias("f_d"), F.when(n1 >= LEAST_DAYS, F.regr_slope(ln(use1, F.col("P")), ln(use1, F.col("DC")))).alias("n"),
        F.when(n2 >= LEAST_DAYS, F.exp(F.regr_intercept(ln(use2, F.col("m")), ln(use2, F.col("P"))))).alias("f_p"), F.when(n2 >= LEAST_DAYS, F.regr_slope(ln(use2, F.col("m")), ln(use2, F.col("P")))).alias("s"), (F.avg("vbar") / F.avg("vt2")).alias("theta"), F.var_pop("P").alias("var"),
    )
    e = F.col("f_d") * F.pow("DC", "n") - F.col("P")
    rest = d.join(fit.select("sensor_uid", "f_d", "n"), "sensor_uid").groupBy("sensor_uid").agg(F.avg(e * e).alias("rest"))
    return fit.join(rest, "sensor_uid").select("sensor_uid", "n_days", "f_d", "n", "f_p", "s", "theta", F.when(F.col("var") > 0, 1 - F.col("rest") / F.col("var")).alias("r2"))


def median_residuals(states: DataFrame, dt_min: int = S.DT_MIN) -> DataFrame:
    """corridor, sensor_uid, slot, date, residual: each cell's speed less the median of its sensor, time of day and kind of
    day (weekdays, weekends). A cell without a reading takes the mean of its sensor and time of day over all days, or of all
    cells of the corridor where that is missing too."""
    slot = F.floor((F.hour("datetime") * 60 + F.minute("datetime")) / dt_min).cast("int")
    cells = states.groupBy("corridor", "sensor_uid", slot.alias("slot"), F.date_format("datetime", "yyyy-MM-dd").alias("date")).agg(F.avg("speed_mph").alias("v"))
    days = cells.select("corridor", "date").distinct()
    grid = cells.select("corridor", "sensor_uid").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(24 * 60 // dt_min - 1)))).join(days, "corridor")
    mean, every = cells.groupBy("sensor_uid", "slot").agg(F.avg("v").alias("mean")), cells.groupBy("corridor").agg(F.avg("v").alias("every"))
    df = grid.join(cells, ["corridor", "sensor_uid", "slot", "date"], "left").join(mean, ["sensor_uid", "slot"], "left").join(F.broadcast(every), "corridor")  # a row a corridor
    df = df.withColumns({"v": F.coalesce("v", "mean", "every"), "weekend": F.weekday(F.to_date("date")) >= 5})
    base = df.groupBy("sensor_uid", "slot", "weekend").agg(F.percentile("v", F.lit(0.5)).alias("base"))
    return df.join(base, ["sensor_uid", "slot", "weekend"]).select("corridor", "sensor_uid", "slot", "date", (F.col("v") - F.col("base")).alias("residual"))


def anomaly_days(residuals: DataFrame, times: float = 4.0, dt_min: int = S.DT_MIN) -> DataFrame:
    """corridor, date, energy, n_cells: what is left of a day's negative residuals when each is drawn to zero by ``times``
    over the root of the corridor's cells a day, summed: mph by which speeds fall short of such days."""
    m = residuals.groupBy("corridor").agg(F.countDistinct("sensor_uid").alias("sensors"))
    df = residuals.join(F.broadcast(m), "corridor").withColumn("cut", times / F.sqrt(F.col("sensors") * (24 * 60 // dt_min)))  # a row a corridor
    short = F.greatest(-F.col("residual") - F.col("cut"), F.lit(0.0))
    # means of thirds of the speeds' grid can fall on the cut itself, where the order of a sum would decide
    beyond = F.round(-F.col("residual") - F.col("cut"), 9) > 0
    return df.groupBy("corridor", "date").agg(F.sum(short).alias("energy"), F.count_if(beyond).alias("n_cells"))
