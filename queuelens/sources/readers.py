"""Readers of detector and probe formats into the states contract, and the synthetic corridor."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens import schemas as S
from queuelens.functions.traffic import density, s3_flow
from queuelens.operators.priors import resolve


def as_states(df: DataFrame) -> DataFrame:
    """Projects to the contract; columns that a source lacks are null. NaN counts as missing."""
    out = []
    for f in S.STATES:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        out.append((F.when(~F.isnan(c), c) if f.dataType.simpleString() == "double" else c).alias(f.name))
    return df.select(*out)


def _missing(df: DataFrame, needed: set[str]) -> None:
    if lacking := sorted(needed - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(lacking)}")


def _local(ts: str) -> Column:
    """Naive local time; a trailing Z doesn't stand for UTC in these feeds and is dropped."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.col(ts).cast("string"), "T", " "), "Z$", "")).cast("timestamp_ntz")


def between(df: DataFrame, t_start: str | None, t_end: str | None) -> DataFrame:
    """Rows from t_start up to t_end, both included; either may be open."""
    if t_start:
        df = df.where(F.col("datetime") >= F.lit(t_start).cast("timestamp_ntz"))
    return df.where(F.col("datetime") <= F.lit(t_end).cast("timestamp_ntz")) if t_end else df


def _beside(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of a folder's files whose names match, by Spark's file listing; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return sorted(r.path for r in files.select("path").collect())


def read_compact_json(spark: SparkSession, path: str, info_csv: str | None = None, t_start: str | None = None, t_end: str | None = None) -> DataFrame:
    """{sensor: {meta, t0, dt, n, f[], s[], d[]}}: arrays of flow, speed (km/h) and density by time steps of dt. Without
    ``info_csv`` a sensor_information.csv beside the file is taken, if there is one."""
    if info_csv is None and "/" in path:
        info_csv = next(iter(_beside(spark, path.rsplit("/", 1)[0], "sensor_information.csv")), None)
    schema = "map<string, struct<t0: string, dt: string, n: int, f: array<double>, s: array<double>, d: array<double>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("sensor", "x")).where("x.n > 0")
    rows = whole.select("sensor", F.col("x.t0").alias("t0"), F.coalesce(F.regexp_extract("x.dt", r"([0-9]+)", 1).cast("int"), F.lit(S.DT_MIN)).alias("dt"), F.posexplode(F.arrays_zip("x.f", "x.s", "x.d")).alias("at", "v"))
    df = rows.select(
        F.concat(F.lit("pems::"), "sensor").alias("sensor_uid"),
        (_local("t0") + F.make_dt_interval(mins=F.col("at") * F.col("dt"))).alias("datetime"),
        (F.col("v.s") / S.KMH_PER_MPH).alias("speed_mph"),
        F.col("v.f").alias("flow_vph"),
        F.col("v.d").alias("density_vpm"),
        F.lit(True).alias("has_volume"),
        F.lit(False).alias("flow_synthetic"),
        F.lit("pems_compact_json").alias("source_format"),
    )
    if info_csv:
        info = spark.read.csv(info_csv, header=True, inferSchema=True)
        info = info.select(F.concat(F.lit("pems::"), F.col("sensor_id").cast("string")).alias("sensor_uid"), F.concat_ws("-", "Fwy", "Dir").alias("corridor"), F.col("Dir").alias("direction"), F.col("Abs_PM").cast("double").alias("road_order"), F.col("Length").cast("double").alias("length_mi"), F.col("Lanes").cast("double").alias("lanes"))
        df = df.join(info.dropDuplicates(["sensor_uid"]), "sensor_uid", "left")
    return between(as_states(df), t_start, t_end)


def read_probe(
    spark: SparkSession, readings: str, tmc: str, min_confidence: float = 30, min_minutes: int = 1, synthesize: bool = False, prior: str | dict | None = None, t_start: str | None = None, t_end: str | None = None, tmc_ids: list[str] | None = None
) -> DataFrame:
    """Probe readings (1-minute CSV) as 5-minute medians with the newest map row of each segment; flow by the inverse
    S-shaped diagram of a prior if asked for, its free-flow speed from the reference speeds, marked as synthetic. Bins
    without readings stay absent; ``tmc_ids`` and the times prune readings before they are grouped."""
    raw = spark.read.csv(readings, header=True, inferSchema=False)
    _missing(raw, {"tmc_code", "measurement_tstamp", "speed"})
    score = F.try_to_number(F.col("confidence_score"), F.lit("999999.99")) if "confidence_score" in raw.columns else F.lit(min_confidence)
    ref = F.col("reference_speed").try_cast("double") if "reference_speed" in raw.columns else F.lit(None).cast("double")
    rows = raw.select(F.col("tmc_code").alias("tmc"), _local("measurement_tstamp").alias("ts"), F.col("speed").try_cast("double").alias("speed"), ref.alias("ref"), score.cast("double").alias("score"))
    rows = rows.where(F.col("ts").isNotNull() & F.col("speed").isNotNull() & (F.col("score") >= min_confidence))
    rows = between(rows.withColumnRenamed("ts", "datetime"), t_start, t_end).withColumnRenamed("datetime", "ts")
    if tmc_ids:
        rows = rows.where(F.col("tmc").isin(tmc_ids))
    base = resolve(prior)
    bins = rows.groupBy("tmc", F.window("ts", "5 minutes")["start"].alias("datetime")).agg(F.percentile("speed", F.lit(0.5)).alias("speed_mph"), F.percentile("ref", F.lit(0.5)).alias("ref"), F.count(F.lit(1)).alias("n_minutes"))
    meta = spark.read.csv(tmc, header=True, inferSchema=True)
    newest = W.partitionBy("tmc").orderBy(F.desc_nulls_last("active_start_date") if "active_start_date" in meta.columns else F.desc("road_order"))
    meta = meta.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("tmc", F.concat_ws("-", "road", "direction").alias("corridor"), "direction", F.col("road_order").cast("double").alias("road_order"), F.col("miles").cast("double").alias("length_mi"))
    df = bins.where(F.col("n_minutes") >= min_minutes).join(meta, "tmc", "left")
    vf = F.least(F.greatest(F.percentile("ref", F.lit(0.5)).over(W.partitionBy("tmc")) * 1.05, F.lit(50.0)), F.lit(85.0))
    flow = s3_flow("speed_mph", F.coalesce(vf, F.lit(base["vf_mph"])), base["k_critical_vpm"], base["s3_m"], base["lane_capacity_vphpl"]) if synthesize else F.lit(None).cast("double")
    return as_states(df.withColumns({"sensor_uid": F.concat(F.lit("inrix::"), "tmc"), "flow_vph": flow, "has_volume": F.lit(synthesize), "flow_synthetic": F.lit(synthesize), "source_format": F.lit("inrix")}).withColumn("density_vpm", density("flow_vph", "speed_mph")))


def read_detector_csv(spark: SparkSession, states: str, chain: str | None = None, corridor: str = "CORRIDOR") -> DataFrame:
    """Detector states (km/h, all lanes) with observed marks; lanes by the 99th percentile of flow over 1900."""
    raw = spark.read.csv(states, header=True, inferSchema=False)
    _missing(raw, {"station_id", "timestamp", "speed", "flow", "milepost", "is_observed"})
    ident = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    rows = raw.where(F.lower(F.col("is_observed")).isin("1", "1.0", "true")).select(ident("station_id").alias("station"), _local("timestamp").alias("datetime"), F.col("speed").try_cast("double").alias("kmh"), F.col("flow").try_cast("double").alias("flow"), F.col("milepost").try_cast("double").alias("milepost"))
    rows = rows.where("kmh is not null and not isnan(kmh)")
    lanes = F.least(F.greatest(F.bround(F.percentile("flow", F.lit(0.99)).over(W.partitionBy("station")) / 1900, 0), F.lit(1.0)), F.lit(8.0))
    if chain:
        # The chain's rows stand in the road's order; the file is one station a line.
        order = spark.read.csv(chain, header=True, inferSchema=False).select(ident("station_id").alias("station"), F.monotonically_increasing_id().alias("at"))
        order = order.groupBy("station").agg(F.min("at").alias("at")).withColumn("road_order", (F.row_number().over(W.orderBy("at")) - 1).cast("double")).drop("at")
        rows = rows.join(order, "station", "left")
    else:
        rows = rows.withColumn("road_order", F.min("milepost").over(W.partitionBy("station")))
    df = rows.withColumns({"lanes": lanes, "speed_mph": F.col("kmh") / S.KMH_PER_MPH}).withColumn("flow_vph", F.col("flow") / F.col("lanes"))
    return as_states(df.withColumns({"sensor_uid": F.concat(F.lit("v4::"), "station"), "corridor": F.lit(corridor), "density_vpm": density("flow_vph", "speed_mph"), "has_volume": F.lit(True), "flow_synthetic": F.lit(False), "source_format": F.lit("ieee_v4")}))


def read_contract(spark: SparkSession, path: str, fmt: str = "parquet", columns: dict[str, str] | None = None, speed_units: str = "mph", flow_scope: str = "per_lane", min_observed: float = 0.6) -> DataFrame:
    """A table that has the contract's columns, under other names if ``columns`` maps them. Stations seen in less than
    ``min_observed`` of their rows go; speeds of unobserved rows are missing."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.csv(path, header=True, inferSchema=True)
    df = df.withColumnsRenamed({v: k for k, v in (columns or {}).items()})
    _missing(df, {"sensor_uid", "datetime", "speed_mph"})
    if "is_observed" in df.columns:
        seen = F.col("is_observed").cast("double")
        df = df.withColumn("_share", F.avg(seen).over(W.partitionBy("sensor_uid"))).where(F.col("_share") >= min_observed)
        df = df.withColumns({c: F.when(seen == 1, F.col(c)) for c in ("speed_mph", "flow_vph") if c in df.columns})
    if speed_units == "kmh":
        df = df.withColumn("speed_mph", F.col("speed_mph") / S.KMH_PER_MPH)
    if flow_scope == "all_lanes":
        df = df.withColumn("flow_vph", F.col("flow_vph") / F.col("lanes"))
    if "milepost" in df.columns and "road_order" not in df.columns:
        posts = df.groupBy("sensor_uid").agg(F.min("milepost").alias("_post"))
        df = df.join(posts.select("sensor_uid", (F.dense_rank().over(W.orderBy("_post")) - 1).cast("double").alias("road_order")), "sensor_uid")  # one row a station
    return as_states(df)


def read_probe_folder(spark: SparkSession, folder: str, **options) -> DataFrame:
    """An export folder: the first Reading*.csv or .csv.gz by name, with TMC_Identification.csv."""
    found = _beside(spark, folder, "Reading*.csv") + _beside(spark, folder, "Reading*.csv.gz")
    tmc = _beside(spark, folder, "TMC_Identification.csv")
    if not found or not tmc:
        raise FileNotFoundError(f"{folder} needs Reading*.csv[.gz] and TMC_Identification.csv")
    return read_probe(spark, found[0], tmc[0], **options)


def read_weekday(spark: SparkSession, path: str, kind: str = "average") -> DataFrame:
    """Rows of the average-weekday method out of a CSV: ``average`` (link_id, t_min, avg_weekday_speed_mph, ...),
    ``measured`` (quarter hours with link_id, date, time_minutes, speed, volume_per_lane), ``states`` (the contract)."""
    raw = spark.read.parquet(path) if kind == "states" else spark.read.csv(path, header=True, inferSchema=True)
    number = lambda c, d=None: F.col(c).cast("double") if c in raw.columns else F.lit(d).cast("double")
    if kind == "average":
        _missing(raw, {"link_id", "t_min", "avg_weekday_speed_mph"})
        return raw.select(F.col("link_id").cast("string").alias("link_id"), F.lit("Weekday").alias("date"), F.col("t_min").cast("int").alias("t_min"), F.lit(0).alias("weekday"), number("avg_weekday_speed_mph").alias("speed"), number("avg_weekday_flow_veh_per_hr_lane").alias("flow_pl"), number("lanes", 1.0).alias("lanes"), number("length_mi", 1.0).alias("length"))
    if kind == "measured":
        _missing(raw, {"link_id", "date", "time_minutes", "speed"})
        day = F.to_date(F.col("date").cast("string"))
        flow = number("hourly_volume_per_lane") if "hourly_volume_per_lane" in raw.columns else number("volume_per_lane") * 4
        return raw.select(F.col("link_id").cast("string").alias("link_id"), F.date_format(day, "yyyy-MM-dd").alias("date"), F.col("time_minutes").cast("int").alias("t_min"), F.weekday(day).alias("weekday"), number("speed").alias("speed"), flow.alias("flow_pl"), number("lanes", 1.0).alias("lanes"), number("length", 1.0).alias("length"))
    if kind != "states":
        raise ValueError(f"no such kind: {kind}")
    t = F.col("datetime")
    return raw.select(F.col("sensor_uid").alias("link_id"), F.date_format(t, "yyyy-MM-dd").alias("date"), (F.hour(t) * 60 + F.minute(t)).alias("t_min"), F.weekday(t).alias("weekday"), F.col("speed_mph").alias("speed"), F.col("flow_vph").alias("flow_pl"), F.coalesce("lanes", F.lit(1.0)).alias("lanes"), F.coalesce("length_mi", F.lit(1.0)).alias("length"))


def sample_weekdays(states: DataFrame) -> DataFrame:
    """The rows of three working days: the second, the third and the middle one of all working days."""
    days = states.select(F.to_date("datetime").alias("day")).distinct().where(F.weekday("day") < 5)  # few
    place = days.withColumn("r", F.row_number().over(W.orderBy("day"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy()))
    keep = place.where((F.col("r") == 2) | (F.col("r") == 3) | (F.col("r") == F.floor(F.col("n") / 2) + 1)).select("day")
    return states.withColumn("day", F.to_date("datetime")).join(F.broadcast(keep), "day", "left_semi").drop("day")


def on_grid(states: DataFrame, minutes: int = S.DT_MIN) -> DataFrame:
    """Every sensor's rows on a regular grid from its first to its last day, empty bins as rows with missing values."""
    ends = states.groupBy("sensor_uid", "corridor", "road_order", "lanes", "length_mi").agg(F.min(F.to_date("datetime")).cast("timestamp_ntz").alias("a"), F.max(F.to_date("datetime")).cast("timestamp_ntz").alias("b"))
    last = F.col("b") + F.expr(f"interval {24 * 60 - minutes} minutes")
    grid = ends.select("sensor_uid", "corridor", "road_order", "lanes", "length_mi", F.explode(F.sequence("a", last, F.expr(f"interval {minutes} minutes"))).alias("datetime"))
    return as_states(grid.join(states.drop("corridor", "road_order", "lanes", "length_mi"), ["sensor_uid", "datetime"], "left"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """kind, path, size, readiness of the data sets below a folder, told by names and by the headers of the few candidate
    tables; contents are read by the readers only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    name, folder = F.lower(F.element_at(F.split("path", "/"), -1)), F.regexp_replace("path", "/[^/]*$", "")
    df = files.select("path", "size", name.alias("name"), folder.alias("folder"))
    near = df.groupBy("folder").agg(F.collect_set(F.when(F.col("name").isin("tmc_identification.csv", "readings.csv", "train_detector_states.parquet", "sensor_information.csv"), F.col("name"))).alias("near"))
    has = lambda n: F.array_contains("near", n)
    named = lambda p: F.col("name").rlike(p)
    kind = (
        F.when(has("tmc_identification.csv") & has("readings.csv") & named("^readings.csv$"), "inrix_folder")
        .when(named("^train_detector_states.parquet$"), "tfb_release")
        .when(named("(link_performance|pems|tfb_).*[.]json$"), "pems_json")
        .when(named("(reading|speed|5min|tmc).*[.]csv$") & ~named("identification"), "ritis_export")
        .when(named("(trajector|ngsim).*[.](txt|csv)$"), "trajectory")
    )
    hits = df.join(near, "folder").withColumn("kind", kind).where("kind is not null")
    headers = []
    for r in hits.where("kind in ('inrix_folder', 'ritis_export', 'trajectory')").select("path", "kind").collect():  # candidates, not rows
        columns = {c.strip().lower() for c in spark.read.csv(r.path, header=True).columns}
        good = {"tmc_code", "measurement_tstamp"} <= columns if r.kind != "trajectory" else bool(columns & {"lane_identification", "lane num", "local_y", "vehicle id", "vehicle_id"})
        headers.append((r.path, good))
    known = spark.createDataFrame(headers, "path string, good boolean")
    hits = hits.join(known, "path", "left").where("good is not false or kind = 'inrix_folder'")
    ready = (
        F.when((F.col("kind") == "inrix_folder") & ~F.coalesce("good", F.lit(False)), "check the readings' columns")
        .when((F.col("kind") == "ritis_export") & ~has("tmc_identification.csv"), "needs a segment table")
        .when((F.col("kind") == "pems_json") & ~has("sensor_information.csv"), "ready, without sensor information")
        .otherwise("ready")
    )
    return hits.select("kind", F.when(F.col("kind") == "inrix_folder", F.col("folder")).otherwise(F.col("path")).alias("path"), "size", ready.alias("readiness"))


READERS: dict[str, Callable[..., DataFrame]] = {"pems_compact_json": read_compact_json, "inrix_folder": read_probe_folder, "inrix": read_probe, "ieee_v4": read_detector_csv, "parquet": read_contract, "contract_csv": lambda spark, path, **kw: read_contract(spark, path, "csv", **kw)}


def read_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A folder with its sidecar dataset_meta.json (meta_version, name, units.flow_scope, loader, files), by its loader."""
    meta = json.loads(spark.read.text(f"{folder}/dataset_meta.json", wholetext=True).first().value)
    if lacking := [k for k in ("meta_version", "name", "units", "loader", "files") if k not in meta] + ([] if "flow_scope" in meta.get("units", {}) else ["units.flow_scope"]):
        raise ValueError(f"dataset_meta.json lacks {', '.join(lacking)}")
    if meta["loader"] not in READERS:
        raise ValueError(f"no reader for {meta['loader']}")
    files = {k: f"{folder}/{v}" for k, v in meta["files"].items()} or {"folder": folder}
    return READERS[meta["loader"]](spark, **files, **meta.get("options", {}))


def simulate_corridor(spark: SparkSession, sensors: int = 6, days: int = 5, bottleneck: int = 3, seed: int = 0, capacity: float = 1900.0, v_f: float = 65.0) -> DataFrame:
    """A synthetic morning bottleneck: trapezoid demand, a queue that balances it against a capacity which drops by 8 %
    once a queue stands, speeds by position, normal noise. The balance is a fold over each day's ordered demands."""
    bins = F.sequence(F.lit(0), F.lit(287))
    hour = lambda i: i / 12.0
    demand = F.transform(bins, lambda i: capacity * (0.45 + 0.75 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least((hour(i) - 5.5) / 1.5, (10.0 - hour(i)) / 1.5)))))
    dt = S.DT_MIN / 60

    def balance(acc, d):
        cap = F.when(acc["q"] > 0, 0.92 * capacity).otherwise(capacity)
        out = F.least(d + acc["q"] / dt, cap)
        q = F.greatest(F.lit(0.0), acc["q"] + (d - out) * dt)
        return F.struct(q.alias("q"), F.concat(acc["all"], F.array(F.struct(q.alias("queue"), out.alias("out"), d.alias("demand")))).alias("all"))

    start = F.struct(F.lit(0.0).alias("q"), F.expr("cast(array() as array<struct<queue: double, out: double, demand: double>>)").alias("all"))
    day = spark.range(days).select(F.col("id").alias("day"), F.aggregate(demand, start, balance)["all"].alias("bins"))
    rows = day.select("day", F.posexplode("bins").alias("bin", "x")).join(spark.range(sensors).select(F.col("id").alias("pos")))
    reach = F.greatest(F.lit(0.0), 1 - (bottleneck - F.col("pos")) * 40.0 / F.greatest(F.col("x.queue"), F.lit(1.0)))
    queued = (F.col("pos") <= bottleneck) & (F.col("x.queue") > 5) & (reach > 0)
    speed = F.when(queued, F.greatest(F.lit(12.0), v_f * (1 - reach * (0.5 + 0.25 * F.least(F.lit(1.0), F.col("x.queue") / (0.5 * capacity)))))).otherwise(v_f - 4 * F.col("x.demand") / capacity) + 1.5 * F.randn(seed)
    df = rows.select(
        F.format_string("SIM%02d", "pos").alias("sensor_uid"),
        (F.lit("2025-06-02 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("day").cast("int"), F.lit(0), F.col("bin") * S.DT_MIN)).alias("datetime"),
        F.greatest(F.lit(3.0), speed).alias("speed_mph"),
        F.when(F.col("pos") <= bottleneck, F.col("x.out")).otherwise(F.least(F.col("x.out"), F.col("x.demand"))).alias("flow_vph"),
        F.lit(3.0).alias("lanes"), F.lit(0.5).alias("length_mi"), F.col("pos").cast("double").alias("road_order"), F.lit("SIM").alias("corridor"), F.lit("N").alias("direction"), F.lit(True).alias("has_volume"), F.lit(False).alias("flow_synthetic"), F.lit("simulated").alias("source_format"),
    )
    return as_states(df.withColumn("density_vpm", density("flow_vph", "speed_mph")))
