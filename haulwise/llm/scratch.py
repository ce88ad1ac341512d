"""Written intermediate tables and files in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from haulwise.session import shared_dir


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet and read back: later jobs start from files that outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later job reads, in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
