"""Congestion episodes: one for each sensor, date and period, around the lowest speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.functions import traffic as X

KEYS = ["sensor_uid", "corridor", "date", "period"]
#: Where an id stands for several sensors: the keys of its rows as one series, and the order of those of one time.
BY_ID, TIED = ["sensor_uid", "date", "period"], ["corridor", "road_order", "place"]


def labelled(qc: DataFrame, period: Column | None = None) -> DataFrame:
    """Rows with their date and period; speeds that fail quality control are missing."""
    df = qc.withColumn("date", F.date_format("datetime", "yyyy-MM-dd")).withColumn("period", X.period_of("datetime") if period is None else period)
    return df.withColumn("v", F.when(F.col("qc_pass"), F.col("speed_mph_clean")) if "qc_pass" in qc.columns else F.col("speed_mph"))


def day_periods() -> Column:
    """A row for each of a time's day periods: 10 to 20 h takes part in the merged one too, in one pass."""
    period, hour = X.period_of("datetime"), F.hour("datetime")
    return F.explode(F.array_compact(F.array(F.when(period != "NT", period), F.when((hour >= 10) & (hour < 20), F.lit("MDPM")))))


def sliced(qc: DataFrame, period: Column | None = None, only: DataFrame | None = None, by_id: bool = False) -> DataFrame:
    """Labelled rows with their place in the period (from 0); rows of one time in the order that classify() has. only: the
    sensor_uid, date and period of the periods that are asked for. by_id: as in classify()."""
    tied = [c for c in TIED if c in qc.columns] if by_id else [c for c in ("v", "flow_vph") if c == "v" or c in qc.columns]
    rows = labelled(qc, period)
    rows = rows if only is None else rows.join(only, ["sensor_uid", "date", "period"], "left_semi")
    return rows.withColumn("idx", F.row_number().over(W.partitionBy(*(BY_ID if by_id else KEYS)).orderBy("datetime", *tied)) - 1)


def _reach(marks: Column) -> Column:
    """How many places an episode goes on, from marks that begin at its lowest speed: to the last L before a break."""
    return F.length(F.rtrim(F.split(marks, "HH|GGG", 2)[0], F.lit("HG"))) - 1


def classify(rows: DataFrame, v_c: float | Column = S.DEFAULT_VC_MPH, dt_min: float = S.DT_MIN, by_id: bool = False) -> DataFrame:
    """One row for each key: boundaries, duration, demand, discharge window and regime. v_c: a speed for all, or a column
    that is the same for all rows of a sensor.

    From the lowest speed outwards an episode ends before two known speeds above v_c in a row or three missing ones;
    its bounds are the last speeds at or below v_c. A key's rows, at most a day's period, become one sorted list, and a
    string with a mark for each (L at or below v_c, H above it, G missing): both scans are a split at the first break.
    One shuffle, no window. Groups of fewer than six rows are left out.

    by_id: all rows of an id are one series, on whatever corridors they are, and the bounds are places in it; each corridor
    has a row with these bounds and their times, and with the demand, mean speed and discharge window of its own rows in them.
    """
    v_c = v_c if isinstance(v_c, Column) else F.lit(float(v_c))
    mark = lambda b: F.when(b["v"].isNull(), "G").when(b["v"] <= F.col("v_c_mph"), "L").otherwise("H")
    at = "datetime" if "datetime" in rows.columns else "idx"
    tied = [c for c in TIED if c in rows.columns] if by_id else []
    bins = F.sort_array(F.collect_list(F.struct(at, *tied, "v", F.col("flow_vph").alias("q"))))
    order = [F.min("road_order").alias("road_order")] if "road_order" in rows.columns and not by_id else []
    df = rows.groupBy(*(BY_ID if by_id else KEYS)).agg(bins.alias("bins"), F.first(v_c).alias("v_c_mph"), *order)
    df = df.withColumn("n_bins", F.size("bins")).where("n_bins >= 6")
    here = lambda b: b["corridor"].eqNullSafe(F.col("corridor"))
    own = lambda bins: F.filter(bins, here) if by_id else bins
    if by_id:
        df = df.withColumn("corridor", F.explode(F.array_distinct("bins.corridor")))
    least = F.array_min(F.transform("bins", lambda b, i: F.when(b["v"].isNotNull(), F.struct(b["v"].alias("v"), i.alias("at")))))
    df = df.withColumns({"worst": least, "marks": F.array_join(F.transform("bins", mark), "")})
    df = df.withColumns({"dc_existence": F.coalesce(F.col("worst.v") <= F.col("v_c_mph"), F.lit(False)), "t2_index": F.coalesce("worst.at", F.lit(0))})
    begins = F.col("t2_index") - _reach(F.reverse(F.substring("marks", F.lit(1), F.col("t2_index") + 1)))
    ends = F.col("t2_index") + _reach(F.substring("marks", F.col("t2_index") + 1, F.col("n_bins")))
    found = F.col("dc_existence")
    df = df.withColumns({"t0_index": F.when(found, begins).otherwise(0), "t3_index": F.when(found, ends).otherwise(0)})
    # The discharge window: falling flow below v_c between the worst bin and the end.
    after = F.greatest(F.col("t3_index") - F.col("t2_index"), F.lit(0))
    df = df.withColumns(
        {
            "span": own(F.slice("bins", F.col("t0_index") + 1, F.col("t3_index") - F.col("t0_index") + 1)),
            "tail": F.slice("bins", F.col("t2_index") + 2, after),
            "flows": F.slice("bins.q", F.col("t2_index") + 2, after),
        }
    ).withColumn("counted", F.exists("flows", lambda q: q.isNotNull()))
    falls = lambda b, j: F.when(j == 0, b["q"].isNotNull()).otherwise(F.coalesce(b["q"] <= F.get("flows", j - 1), F.lit(False)))
    slow = lambda b: F.coalesce(b["v"] < F.col("v_c_mph"), F.lit(False)) & (here(b) if by_id else F.lit(True))
    keep = lambda b, j: F.when(slow(b) & (~F.col("counted") | falls(b, j)), j)
    df = df.withColumn("kept", F.array_compact(F.transform("tail", keep)))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))
    speeds = F.array_compact("span.v")
    enough = F.size("kept") >= S.DISCHARGE_MIN_BINS
    discharge = lambda place: F.when(enough, place + F.col("t2_index") + 1)
    out = df.select(
        *KEYS,
        "n_bins",
        "t0_index",
        "t2_index",
        "t3_index",
        F.col("worst.v").alias("min_speed_mph"),
        "dc_existence",
        F.when(F.col("worst").isNotNull(), total(F.col("span.q")) * dt_min / 60).otherwise(0.0).alias("demand_veh"),
        F.when(F.size(speeds) > 0, total(speeds) / F.size(speeds)).alias("cong_mean_speed"),
        "v_c_mph",
        discharge(F.array_min("kept")).alias("discharge_start_idx"),
        discharge(F.array_max("kept")).alias("discharge_end_idx"),
        *(["road_order"] if order else [F.array_min(own(F.col("bins"))["road_order"]).alias("road_order")] if "road_order" in tied else []),
        *([F.get("bins", F.col(f"{t}_index"))[at].alias(f"{t}_time") for t in ("t0", "t2", "t3")] if by_id else []),
        F.when(found, (F.col("t3_index") - F.col("t0_index") + 1) * float(dt_min)).otherwise(0.0).alias("P_min"),
        enough.alias("_enough"),
    )
    valid = (F.col("P_min") >= S.UNCONGESTED_BELOW_MIN) & F.coalesce(F.col("min_speed_mph") < F.col("v_c_mph"), F.lit(False)) & F.col("_enough")
    return out.withColumn("is_valid_for_mu", valid).withColumn("regime", X.regime("P_min", "min_speed_mph", "v_c_mph")).drop("_enough")


def merged_over_16h(episodes: DataFrame, dt_min: float = S.DT_MIN, by_id: bool = False) -> DataFrame:
    """Of the MDPM episodes (10 to 20 h) those stay where a queue crosses 16 h: MD ends in its last bin and PM begins in
    its first. The two parts stay, but no longer count as valid. by_id: as in classify(); then a day's episodes but the
    merged ones stand once for each pair of an MD and a PM episode that cross, as a join with those pairs has them."""
    last = (S.PERIODS["MD"][1] - S.PERIODS["MD"][0]) * 60 // int(dt_min) - 1
    day = W.partitionBy("sensor_uid", "date") if by_id else W.partitionBy("sensor_uid", "corridor", "date")
    ends = F.bool_or((F.col("period") == "MD") & F.col("dc_existence") & (F.col("t3_index") >= last)).over(day)
    begins = F.bool_or((F.col("period") == "PM") & F.col("dc_existence") & (F.col("t0_index") == 0)).over(day)
    df = episodes.withColumn("_crosses", ends & begins).where((F.col("period") != "MDPM") | F.col("_crosses"))
    if by_id:
        pairs = F.count_if(F.col("period") == "MD").over(day) * F.count_if(F.col("period") == "PM").over(day)
        df = df.withColumn("_pairs", F.when(F.col("_crosses") & (F.col("period") != "MDPM"), pairs).otherwise(1).cast("int"))
        df = df.withColumn("_pair", F.explode(F.sequence(F.lit(1), "_pairs"))).drop("_pairs", "_pair")
    part = F.col("_crosses") & F.col("period").isin("MD", "PM")
    return df.withColumn("is_valid_for_mu", F.col("is_valid_for_mu") & ~part).drop("_crosses")


def with_events(episodes: DataFrame) -> DataFrame:
    """Severe and recurring episodes whose duration is an outlier for its sensor and period turn into events."""
    group = W.partitionBy("sensor_uid", "period")
    df = episodes.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_med", F.percentile("P_min", F.lit(0.5)).over(group))
    df = df.withColumn("_dev", F.abs(F.col("P_min") - F.col("_med"))).withColumn("_mad", F.percentile("_dev", F.lit(0.5)).over(group) * S.MAD_SCALE)
    event = (F.col("_n") >= 5) & (F.col("_mad") > 0) & (F.col("_dev") / F.col("_mad") > S.EVENT_Z) & F.col("regime").isin("severe", "recurring")
    return df.withColumn("regime", F.when(event, "event").otherwise(F.col("regime"))).drop("_n", "_med", "_dev", "_mad")


def find_episodes(qc: DataFrame, v_c: float = S.DEFAULT_VC_MPH, dt_min: float = S.DT_MIN, by_sensor: DataFrame | None = None, by_id: bool = False) -> DataFrame:
    """All episodes of the day periods: detection, the merge over 16 h, then events. by_sensor: sensor_uid, v_c_mph, the
    critical speed of each sensor's diagram; sensors without one take ``v_c``. by_id: as in classify()."""
    rows = labelled(qc, day_periods())
    if by_sensor is not None:
        rows = rows.join(by_sensor.select("sensor_uid", F.col("v_c_mph").alias("_v_c")), "sensor_uid", "left").withColumn("_v_c", F.coalesce("_v_c", F.lit(float(v_c))))
    return with_events(merged_over_16h(classify(rows, v_c if by_sensor is None else F.col("_v_c"), dt_min, by_id), dt_min, by_id))


def sensor_reliability(episodes: DataFrame) -> DataFrame:
    """Counts of episodes and of valid ones, how often each regime occurs, and the reliability class."""
    counts = episodes.groupBy("sensor_uid", "regime").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_valid_for_mu").cast("long")).alias("valid"))
    by = counts.groupBy("sensor_uid").agg(
        F.sum("n").alias("n_episodes_total"),
        F.sum("valid").alias("n_episodes_valid"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("regime", "n")))).alias("regime_counts"),
    )
    return by.withColumn("reliability_class", X.reliability("n_episodes_valid"))


def with_times(episodes: DataFrame, qc: DataFrame) -> DataFrame:
    """Adds t0_time, t2_time and t3_time: the clock of each place in its period, by equi-joins."""
    merged = sliced(qc.where((F.hour("datetime") >= 10) & (F.hour("datetime") < 20)), F.lit("MDPM"))
    place = F.coalesce("corridor", F.lit("")).alias("_place")
    slots = sliced(qc).unionByName(merged).select("sensor_uid", place, "date", "period", "idx", "datetime")
    episodes = episodes.withColumn("_place", place)
    for name in ("t0", "t2", "t3"):
        clock = slots.select("sensor_uid", "_place", "date", "period", F.col("idx").alias(f"{name}_index"), F.col("datetime").alias(f"{name}_time"))
        episodes = episodes.join(clock, ["sensor_uid", "_place", "date", "period", f"{name}_index"], "left")
    return episodes.drop("_place")
