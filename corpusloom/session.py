"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()
#: Tables that were stored and not dropped, by application.
_STORED: dict[str, set[str]] = {}
#: What one batch of rows may hold on its way to a Python worker, so that long texts don't add up.
BATCH_BYTES = 8 << 20


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, and bound the batches that they get.

    Workers unpickle functions by module name; they need not have the repository on a path of their own.
    Tables that are dealt by an id may be joined on that id and more without being dealt anew.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = Path(tempfile.mkdtemp(prefix="corpusloom-")) / f"{root.name}.zip"
    path.write_bytes(packed.getvalue())
    sc.addPyFile(str(path))
    _SENT.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results, the cluster's spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a folder of its own; on a cluster that is an error, as executors would
    write to disks that no other can read.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder; their lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows, written as a table to the shared folder and read again, and where; of use where few of the columns are read later.

    A table that nobody drops goes when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that was stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _STORED.get(spark.sparkContext.applicationId, set()).discard(path)


@atexit.register
def _drop_stored() -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
        spark = SparkSession.getActiveSession()
        for path in list(_STORED.get(spark.sparkContext.applicationId, ())) if spark else ():
            dropped(spark, path)


class Scratch:
    """Tables of one computation: what it doesn't return is dropped at its end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        table, path = stored(df)
        self.paths.append(path)
        return table

    def drop(self, after: int = 0) -> None:
        """Drop all tables but the first ``after``."""
        for path in self.paths[after:]:
            dropped(self.spark, path)
        del self.paths[after:]
