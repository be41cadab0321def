"""State between micro-batches as a versioned table in the shared store.

A batch reads the folders of the batches before it and writes what it changed into its own, so a
repeated batch starts from the same state and replaces its own output. Every `SNAPSHOT` batches all
rows that still live are written, and older folders go.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.staging import remove

SNAPSHOT = 16
FIELDS = "url string, what string, at long, open boolean"


class StateTable:
    """Rows (url, what, at, open). `due`: when a url is scanned anew; `last`: its last event and whether
    that was a permission; `timer`: the start of each permission; `clock`: the latest event of a batch."""

    def __init__(self, spark: SparkSession, path: str, number: int):
        self.spark, self.path, self.number = spark, path, number
        if number:
            rows = spark.read.schema(f"{FIELDS}, batch long").parquet(path)
            first = (number - 1) // SNAPSHOT * SNAPSHOT
            self.rows = rows.filter(F.col("batch").between(first, number - 1))
        else:
            self.rows = spark.createDataFrame([], f"{FIELDS}, batch long")

    def _latest(self, what: str, rows: DataFrame) -> DataFrame:
        newest = F.max(F.struct("batch", "at", "open")).alias("s")
        return rows.filter(F.col("what") == what).groupBy("url").agg(newest).select("url", "s.at", "s.open")

    def due(self) -> DataFrame:
        return self._latest("due", self.rows).select("url", F.col("at").alias("due"))

    def last(self) -> DataFrame:
        return self._latest("last", self.rows)

    def timers(self) -> DataFrame:
        return self.rows.filter("what = 'timer'").select("url", "at").distinct()

    def write(self, changed: DataFrame, lifetime: int, late: int) -> None:
        """Store `changed` (url, what, at, open) of this batch. Rows live for `lifetime` microseconds, and
        `late` more, after their time."""
        out = changed
        whole = self.number > 0 and self.number % SNAPSHOT == 0
        if whole:
            every = self.rows.unionByName(changed.withColumn("batch", F.lit(self.number).cast("long")))
            clock = every.filter("what = 'clock'").agg(F.max("at")).first()[0]
            kept = [self._latest(what, every).select("url", F.lit(what).alias("what"), "at", "open") for what in ("due", "last", "clock")]
            kept.append(every.filter("what = 'timer'").select("url", "what", "at", "open").distinct())
            out = kept[0]
            for more in kept[1:]:
                out = out.union(more)
            if clock is not None:
                # A url that is not open needs no row: that is what a url without state is.
                lives = F.col("at") + F.when(F.col("what") == "due", 0).otherwise(lifetime) > clock - late
                out = out.filter(lives & ((F.col("what") != "last") | F.col("open")))
        out.select("url", "what", "at", "open").write.mode("overwrite").parquet(f"{self.path}/batch={self.number}")
        if whole:
            # The snapshot before stays, for a batch that is repeated.
            for old in range(max(0, self.number - 2 * SNAPSHOT), self.number - SNAPSHOT):
                remove(self.spark, f"{self.path}/batch={old}")
