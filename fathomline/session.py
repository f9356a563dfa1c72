"""Session set-up, the shared work folder and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# What a run needs whatever its size. Shuffle partitions and memory stay with
# the cluster; AQE coalesces small partitions and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def local_session(cores: int | str = "*", app: str = "fathomline", **conf: str) -> SparkSession:
    """Session for one machine: tests, the bench and trial runs."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    }
    for key, value in {**SETTINGS, **defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Folder of this application for intermediate tables, the same on every master.

    It lies in ``spark.checkpoint.dir``; where that is not set, in the warehouse folder,
    which driver and executors share too. Without either the call fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/fathomline-{spark.sparkContext.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the work folder and read back.

    For results that several branches of a plan need: the work behind them is done
    once, all branches see the same digits, lost executors do not bring it back, and the
    planner knows the size and broadcasts or shuffles by it. A checkpoint would run
    the last stage twice.
    """
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of a store that Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_work(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results read from them must be written before."""
    remove_folder(spark, work_folder(spark))


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application; needed before Python runs in tasks."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="fathomline-package-"), "fathomline-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
