"""Tables between the steps of an operator, in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that a lost executor
    costs a read and not another run."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for name in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
