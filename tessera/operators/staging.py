"""Tables that several plans read: written once, so that what they cost is paid once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir; in local mode without it, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/tessera/files-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written in the folder of spark.checkpoint.dir and read back, which also survives lost executors; kept in memory and on disk where a session names no folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/tessera/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
