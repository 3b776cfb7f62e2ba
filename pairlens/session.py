"""Session helpers: local sessions for tests and bench, shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def local_session(
    cores: int | str = 8, shuffle_partitions: int = 8, name: str = "pairlens", conf: dict[str, str] | None = None
) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are pickled by name, so the workers must be
    able to import the package even where it is not installed and was found through
    the driver's own path.
    """
    context = spark.sparkContext
    if getattr(context, "_pairlens_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="pairlens-package-")  # read by the driver's own file server only
    archive = os.path.join(folder, "pairlens_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(archive)
    context._pairlens_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster always names one, in the session or by ``setCheckpointDir``.  Only on one
    machine, where it is unset, a temporary folder takes its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = named.get() if named.isDefined() else None
    if not path:
        path = spark.conf.get("pairlens.scratch.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        path = tempfile.mkdtemp(prefix="pairlens-")
        spark.conf.set("pairlens.scratch.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; the application owns it and removes it when it ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, label: str = "stage", rebalance: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used before work that reads the same result many times (iterative fits).
    The table outlives lost executors, and stays columnar, so later reads still
    prune columns and push filters down.  ``rebalance`` evens out the file sizes
    first, which pays off when every pass starts one task per file.
    """
    path = scratch_path(df.sparkSession, label)
    (df.hint("rebalance") if rebalance else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
