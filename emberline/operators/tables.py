"""Tables that cut the lineage of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def kept_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; where it is unset (tests, local mode) below the warehouse, which a cluster may not share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{root.rstrip('/')}/emberline-{uuid.uuid4().hex}"


def kept_table(df: DataFrame) -> DataFrame:
    """df written to a fresh folder and read again."""
    path = kept_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
