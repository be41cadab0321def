"""Query catalogue: a Spark callable and, where one exists, its SQL check."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from suite import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The given tables and the decorated views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        tables = {t: self.table(t) for t in views.TABLES[name]}
        return self.spark.sql(views.VIEWS[name], **tables)


def query(name: str, sql: str | None = None):
    """Register a function of Inputs; its columns become plain scalars."""

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(build(Inputs(spark, folder)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, lists as joined text, so that both engines compare alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            if isinstance(inner, T.StructType):
                c = F.transform(c, lambda s: F.concat_ws("|", *[s[n].cast("string") for n in inner.names]))
            c = F.array_join(c, ";")
        out.append(c.alias(f.name))
    return df.select(*out)
