"""Writers: partitioned tables, token lines, and GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_states(df: DataFrame, path: str) -> None:
    """Parquet by corridor and date; rows of a partition are brought together first, so each has few files."""
    dated = df.withColumn("date", F.to_date("datetime"))
    dated.repartition("corridor", "date").sortWithinPartitions("sensor_uid", "datetime").write.mode("overwrite").option("compression", "zstd").partitionBy("corridor", "date").parquet(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """One JSON line for each token, and a flat CSV of the events."""
    tokens.write.mode("overwrite").json(f"{path}/tokens")
    tokens.select("sensor_uid", "date", "period", "states.*", "metrics.*").write.mode("overwrite").option("header", True).csv(f"{path}/events")


def write_memo(tokens: DataFrame, path: str) -> None:
    """A Markdown list of the tokens' messages, a line for each, by day and sensor."""
    line = F.concat(F.lit("- **"), "sensor_uid", F.lit("** "), "date", F.lit(" "), "period", F.lit(": "), "public_message")
    tokens.orderBy("date", "sensor_uid", "period").select(line.alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A stage's table as Parquet (zstd), CSV with a header, or JSON lines (issue graphs, source registries)."""
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    writer.option("header", True).format(fmt).save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """What write_table() wrote."""
    return spark.read.option("header", True).option("inferSchema", True).format(fmt).load(path)


def geojson_line(points: Column, *properties: str) -> Column:
    """A GeoJSON feature of a line through points (arrays of longitude and latitude) as text."""
    geometry = F.struct(F.lit("LineString").alias("type"), points.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def geojson_point(lon: str, lat: str, *properties: str) -> Column:
    """A GeoJSON feature of a point as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))
