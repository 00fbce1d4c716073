"""Helpers that the corpus operators share: intermediate tables and text conventions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: The same as a regular-expression class.
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset the warehouse.

    Only a local session, whose driver and executors are one process, gets a temporary folder; on a
    cluster a warehouse on a local disk is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="weblens-shared-")
        spark.sparkContext.setCheckpointDir(found)
        return found
    found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if found.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{found}/weblens-staged"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    That cuts the lineage: what is read back survives the loss of any executor and is
    computed once, however many branches of a plan read it.  The table goes with ``discard``,
    or at the end of the application at the latest.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weblens-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    place, system = _path(spark, path)
    system.deleteOnExit(place)
    for tables in _scopes:
        tables.append(path)
    back = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    back.staged_path = path
    return back


def key_buckets(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions, so that rows grouped by the buckets' keys lie as a table needs them."""
    own = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(own or spark.conf.get("spark.sql.shuffle.partitions"))


def stage_sorted(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """``stage`` as a table of ``buckets`` buckets by ``keys``, each sorted by them: joins on them needn't shuffle it."""
    spark = df.sparkSession
    table = f"weblens_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/weblens-{name}-{table[8:]}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    place, system = _path(spark, path)
    system.deleteOnExit(place)
    for tables in _scopes:
        tables.append(path)
    back = spark.read.table(table)
    back.staged_path, back.staged_table = path, table
    return back


#: What makes plans use the buckets of ``stage_sorted`` and their order.
_BY_BUCKETS = {
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


@contextmanager
def by_buckets(spark: SparkSession) -> Iterator[None]:
    """Within the block, plans read the tables of ``stage_sorted`` by bucket and in order; settings are put back after it.

    Join such tables there, don't unite them: a union of columnar scans lays their buckets side by side, yet
    is taken to keep them, and what is grouped on it comes out in parts.
    """
    before = {k: spark.conf.get(k, None) for k in _BY_BUCKETS}
    for k, v in _BY_BUCKETS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(*staged: DataFrame) -> None:
    """Delete tables written by ``stage`` or ``stage_sorted`` that nothing still to be computed reads."""
    for df in staged:
        if hasattr(df, "staged_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.staged_table}")
        place, system = _path(df.sparkSession, df.staged_path)
        system.delete(place, True)


_scopes: list[list[str]] = []


@contextmanager
def staged_within(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Delete all tables staged inside the block at its end, but for those put into the list it gives."""
    tables: list[str] = []
    kept: list[DataFrame] = list(keep)
    _scopes.append(tables)
    try:
        yield kept
    finally:
        _scopes.remove(tables)
        for path in set(tables) - {df.staged_path for df in kept}:
            place, system = _path(spark, path)
            system.delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


_WHITE_SPACE = re.compile(WHITE_CLASS)


def pieces_of(text: str, size: int, overlap: int = 0) -> list[str]:
    """A text in pieces of ``size`` code points or somewhat more, each from white space to white space.

    So memory follows ``size`` and not the longest text.  A piece begins at white space ``overlap`` or
    more code points before the last one's end.  Where no white space follows, the rest stays whole.
    """
    out, at = [], 0
    while len(text) - at > 2 * size:
        found = _WHITE_SPACE.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = max(text.rfind(" ", at + 1, found.start() - overlap), at + 1) if overlap else found.start()
    return [*out, text[at:]] if out else [text]


def slices(batch, rows: int = 512):
    """An Arrow batch or array in parts of so many rows: texts become Python strings a part at a time."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def salted(df: DataFrame, salts: int, name: str = "_salt") -> DataFrame:
    """Every row ``salts`` times, once per salt: the small side of a join whose large side has hot keys."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
