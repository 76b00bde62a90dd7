"""Written tables that cut lineage: in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets a folder of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "marram-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written as Parquet and read back: computed once, and re-read if an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marram/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
