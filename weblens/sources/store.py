"""Tables that the engine writes once and reads many times: tiers by date, and when virtual hosts were seen.

They lie under the folder that all executors share and go at the end of the application.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weblens.sources import sinks


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset the warehouse; a local session has a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="weblens-shared-")
        spark.sparkContext.setCheckpointDir(found)
        return found
    found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if found.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found


def file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def state_of(spark: SparkSession, path: str) -> str:
    """Size and time of change of what lies at a path: another state means other tables."""
    place, system = file_system(spark, path)
    status = system.getFileStatus(place)
    return f"{status.getModificationTime()}-{system.getContentSummary(place).getLength()}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that rounds of a loop don't pile up plans; it goes at the
    end of the application."""
    path = f"{root(df.sparkSession)}/weblens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, system = file_system(df.sparkSession, path)
    system.deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """The stored tables that derive from one input."""

    _roots: dict[tuple[str, str, str], str] = {}
    _values: dict[tuple[str, str], object] = {}

    def __init__(self, spark: SparkSession, source: str, *inputs: str) -> None:
        key = (spark.sparkContext.applicationId, source, "|".join(state_of(spark, f"{source}/{x}") for x in inputs))
        if key not in self._roots:
            path = f"{root(spark)}/weblens-store-{hashlib.md5(repr(key).encode()).hexdigest()}"
            place, system = file_system(spark, path)
            system.deleteOnExit(place)
            self._roots[key] = path
        self.spark, self.path = spark, self._roots[key]

    def _done(self, name: str) -> bool:
        place, system = file_system(self.spark, f"{self.path}/{name}/_STORED")
        return system.exists(place)

    def _finish(self, name: str) -> None:
        """Mark a table as whole, which a writer that replaces single days doesn't."""
        place, system = file_system(self.spark, f"{self.path}/{name}/_STORED")
        system.create(place, True).close()

    def tier(self, name: str, tier: str, rows: Callable[[], DataFrame], start: int | None = None, end: int | None = None) -> DataFrame:
        """A tier's rows from ``start`` to ``end``; ``rows`` gives all of them where none are stored yet."""
        path = f"{self.path}/{name}-{tier}"
        if not self._done(f"{name}-{tier}"):
            sinks.write_tier(rows(), path, tier)
            self._finish(f"{name}-{tier}")
        place, system = file_system(self.spark, f"{path}/tier={tier}")
        if not system.exists(place):  # a tier without rows has no days
            return self.spark.createDataFrame([], rows().schema)
        return sinks.read_tier(self.spark, path, tier, start, end)

    def table(self, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """A small table; ``rows`` gives it where it isn't stored yet."""
        if not self._done(name):
            rows().write.mode("overwrite").parquet(f"{self.path}/{name}")
            self._finish(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def value(self, name: str, find: Callable[[], object]) -> object:
        """A single value that derives from the input; ``find`` gives it the first time."""
        key = (self.path, name)
        if key not in self._values:
            self._values[key] = find()
        return self._values[key]
