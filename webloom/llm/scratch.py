"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage and survives the loss of executors, and a plan that
reads it twice pays for its input once.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where it is unset and driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed by ``sweep`` or when the process ends."""
    path = f"{shared_dir(spark)}/webloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame over what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of two or three numbers that may be broadcast: some tens of MB at most.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of a few narrow columns, marked for a broadcast if it has no more than ``rows`` rows; larger ones meet by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def written() -> list[str]:
    """The tables written and not yet deleted, in order."""
    return [path for _, path in _written]


def sweep(paths: Iterable[str] | None = None) -> None:
    """Delete the given tables, or all written so far. Call it only when no DataFrame over them is still needed."""
    chosen = None if paths is None else set(paths)
    going = [x for x in _written if chosen is None or x[1] in chosen]
    _written[:] = [x for x in _written if x not in going]
    for spark, path in going:
        with contextlib.suppress(Exception):  # the session may have ended already; the others go all the same
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


atexit.register(sweep)
