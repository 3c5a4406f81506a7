"""Session helpers shared by all operators: tables, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Measured bytes up to which a side is broadcast: the session's threshold, within these
#: bounds. The threshold is meant for sizes guessed from files; two measured megabytes
#: are never a burden.
LEAST_BROADCAST, MOST_BROADCAST = 2 << 20, 16 << 20

#: Folders of the tables that ``materialize`` wrote, by application.
_WRITTEN: dict[str, list[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or the
    checkpoint folder set on its context. Where neither is set, a folder of this machine
    is taken if Spark runs on this machine alone; on a cluster that is an error.
    """
    set_by_session = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_session:
        return set_by_session
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage, outlives lost executors and is columnar, so
    that later passes read only the columns they need.
    """
    path = f"{shared_dir(df.sparkSession)}/voltlake-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Removes all tables that this application has materialised. Results that were not
    written or collected before can no longer be read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def row_count_up_to(df: DataFrame, limit: int) -> int:
    return df.limit(limit + 1).count()


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes that a broadcast side may have; none if the session forbids broadcasts."""
    threshold = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return 0 if threshold <= 0 else max(LEAST_BROADCAST, min(threshold, MOST_BROADCAST))


def small_side(df: DataFrame) -> DataFrame:
    """Hint a broadcast if ``df`` was measured to be within the session's limit; else ask
    for a sort-merge join, so that no side is broadcast on a guess from file sizes.

    A row takes 16 bytes, 8 for each field at any depth, and the length of its texts and
    lists as JSON.
    """
    limit = broadcast_limit(df.sparkSession)
    fixed, varying = 16, []

    def walk(kind, column: Column) -> None:
        nonlocal fixed
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(f.dataType, column[f.name])
            return
        fixed += 8
        if isinstance(kind, ArrayType | MapType):
            varying.append(F.length(F.to_json(column)))
        elif isinstance(kind, StringType | BinaryType):
            varying.append(F.octet_length(column))

    for field in df.schema.fields:
        walk(field.dataType, F.col(f"`{field.name}`"))
    most = limit // fixed
    extra = sum((F.coalesce(c, F.lit(0)) for c in varying), F.lit(0)).cast("long")
    n, more = df.select(extra.alias("b")).limit(most + 1).agg(F.count("*"), F.sum("b")).first()
    small = n <= most and n * fixed + (more or 0) <= limit
    return F.broadcast(df) if small else df.hint("merge")


def once_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key. Repeated rows of a key hold the same values; should they differ,
    each column takes its smallest value, so that the result does not depend on order.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest]).select(*df.columns)
