"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that the jobs rely on. The cluster's own values for memory, executors
# and shuffle partitions are left alone.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "martspark", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the master is local does the job make a temporary folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="martspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def working_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever reused or cleared."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df, label: str):
    """Cut lineage: write a frame once to the shared folder and read it back.

    Unlike ``persist`` the copy survives the loss of an executor, and unlike
    recomputation every reader sees the same rows.
    """
    path = working_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int | None:
    """Partitions that bound the rows of one task; none while the cores alone keep them below."""
    tasks = -(-rows // rows_per_task)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application, and what their Python workers need to know.

    Python functions that run in tasks import it; a cluster's machines need not
    have it installed. Spark hands the archive out itself, so it may lie in a
    folder of the driver.
    """
    context = spark.sparkContext
    # Linear algebra in a task keeps to the task's cores. Left alone it starts a thread per core of the
    # executor in every task, and these wait for each other.
    for name in ("OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        context.environment.setdefault(name, context.getConf().get("spark.task.cpus", "1"))
    if getattr(context, "_martspark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="martspark-code-")) / "martspark.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._martspark_shipped = True
