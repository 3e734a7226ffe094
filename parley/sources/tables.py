"""Parquet tables of a data folder, by name."""

from pyspark.sql import DataFrame, SparkSession

from parley.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; any path that Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, a file or a folder, as a stream of its files."""
    ship(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    source = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return source.parquet(f"{sf_dir}/{name}.parquet") if status.isDirectory() else source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
