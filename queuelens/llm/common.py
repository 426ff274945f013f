"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; set a folder only where none is set (tests, one machine)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet into the checkpoint folder and read again: cuts the lineage, survives lost
    executors, and forget() frees it."""
    ensure_checkpoint_dir(df.sparkSession)
    at = f"{df.sparkSession.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._cut_at = at
    return out


def forget(*cuts: DataFrame) -> None:
    """Deletes tables of cut() that nothing will read again."""
    for df in cuts:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_spread(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with groups (one row for each key, with its number of rows in column ``size``), without a task that
    gets all rows of a frequent key. Keys that hold over a thousandth of the rows, fewer than a thousand by that, are
    broadcast; the others are joined by a shuffle."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    often = F.col(size) * 1000 > total
    hot = F.broadcast(groups.where(often))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(~often), keys)
    return rows.join(hot, keys).unionByName(rest)


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A DataFrame of driver-made rows as one JSON literal, so that no Python runs on executors.

    For plans and splitters whose length is bounded by a parameter, never for data.
    """
    text = json.dumps(rows, separators=(",", ":"))
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def utf8_size(col: str = "text"):
    return F.octet_length(text_or_empty(col)).cast("long")
