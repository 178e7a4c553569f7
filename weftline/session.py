"""Session helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "weftline", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    b = SparkSession.builder.appName(app).master(conf.pop("master", "local[8]"))
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context.

    Workers that already find it (PYTHONPATH, an installed wheel) are not
    disturbed: the archive has the same files.
    """
    sc = spark.sparkContext
    if getattr(sc, "_weftline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="weftline-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(name)
    sc._weftline_shipped = True


def shared(spark: SparkSession, what: str) -> str:
    """A new folder's name where driver and executors can all write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/weftline-shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def no_shuffle_left(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it has run."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, what: str = "loop") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a loop's plan doesn't grow and lost executors cost nothing."""
    path = shared(df.sparkSession, what)
    with no_shuffle_left(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    path = getattr(df, "_weftline_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
