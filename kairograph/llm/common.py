"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where it is unset in local mode (tests)."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="kairograph-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def utf8(col: str = "text") -> Column:
    """The text as UTF-8 bytes, null as none: Python's bytes.lower() and bytes.split() then touch ASCII letters and white space only."""
    return text_or_empty(col).cast("binary")


def tasks_for(spark: SparkSession) -> int:
    """Partitions of an explicit repartition: what the session gives its own shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_fields(schema: StructType, ddl: str) -> StructType:
    """``schema`` followed by the columns of ``ddl``."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
