"""Written intermediate tables: they cut lineage and survive the loss of executors."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


OWN_ROOTS: dict[str, str] = {}  # by application, where the session names no folder


def staging_root(spark: SparkSession) -> str:
    """The shared folder that the session names; where it names none, a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    name = spark.sparkContext.applicationId
    if name not in OWN_ROOTS:
        OWN_ROOTS[name] = tempfile.mkdtemp(prefix="riskspark-")
    return OWN_ROOTS[name]


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Use it where several passes follow a shuffle: later passes read only their columns.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(written: DataFrame, key: str) -> DataFrame:
    """A written table in at least as many parts as there are cores: a table of a few row groups would be
    worked off by as many tasks. With more parts than cores nothing moves."""
    cores = written.sparkSession.sparkContext.defaultParallelism
    return written.repartition(cores, key) if written.rdd.getNumPartitions() < cores else written


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store; one that is not there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Staged tables of one piece of work, deleted together when its results are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(staging_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *failure) -> None:
        for path in self.paths:
            remove(self.spark, path)


def hold(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once, at this point of the plan.

    The optimizer pushes a filter below projections by copying the filtered column's
    whole expression into it, for every use inside. A generator is not crossed that way,
    so a filter on a score stays a comparison of a finished column.
    """
    others = [c for c in df.columns if c not in names]
    held = F.inline(F.array(F.struct(*names)))
    return df.select(*others, held).select(*df.columns)
