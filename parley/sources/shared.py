"""Tables in the folder that all machines share: they cut lineage, so that a lost executor costs no recomputing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The folder that all machines share: ``folder`` if given, else the one that the session names.

    Where neither is given, a temporary folder is made in local mode alone, one for each Spark
    context; on a cluster, whose machines would not see each other's files, it is an error.
    """
    named = folder or spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not named:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        if not hasattr(context, "_parley_folder"):
            context._parley_folder = "file://" + tempfile.mkdtemp(prefix="parley-")
        named = context._parley_folder
    return named.rstrip("/")


def new_path(spark: SparkSession, folder: str | None = None) -> str:
    """A path in the shared folder that nothing is at."""
    return f"{shared_folder(spark, folder)}/parley/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    path = new_path(df.sparkSession, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
