"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it again, so a lost
executor costs the recomputation of its running tasks only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PLACES: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only if none is set (local tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = own.get() if own.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        place = _PLACES.setdefault(app, tempfile.mkdtemp(prefix="quarry-"))
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # noqa: BLE001  the session has ended before the process
        pass


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes the rows as Parquet in the shared folder; returns them reread, and the path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage_counting(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, str, dict[str, int]]:
    """As ``stage``, and the numbers of rows for which the conditions hold, taken while the rows are written."""
    seen = Observation()
    spark = df.sparkSession
    path = new_path(spark, name)
    df.observe(seen, *[F.count_if(c).alias(n) for n, c in conditions.items()]).write.parquet(path)
    got = seen.get
    return spark.read.schema(df.schema).parquet(path), path, {n: int(got.get(n) or 0) for n in conditions}


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the broadcasts and shuffles of finished plans, which it does when the driver's JVM has found them unreachable."""
    spark.sparkContext._jvm.System.gc()


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and more fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted names with underscores before them, as many as set them apart from all others."""
    taken = {n.lower() for n in names}
    prefix = "_"
    while any(prefix + w in taken for w in wanted):
        prefix += "_"
    return [prefix + w for w in wanted]
