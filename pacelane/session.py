"""Session settings and the shared work folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app: str = "pacelane", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings every plan here relies on.

    On a cluster ``master`` and ``partitions`` stay unset, so the submit command
    and adaptive execution decide them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    session = builder.getOrCreate()
    ship_package(session)
    return session


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    missing setting is an error, because a machine-local path would not survive
    the loss of an executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[key] = tempfile.mkdtemp(prefix="pacelane-")
    return _LOCAL_FOLDERS[key]


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where several passes follow: the passes read narrow columns of a written
    table instead of each running the whole plan before it, and a lost executor
    costs one task, not the lineage.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pacelane-work/{spark.sparkContext.applicationId}"


def drop_work(spark: SparkSession) -> None:
    """Remove this application's settled tables once their readers are done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started.

    The zipped package goes to the shared folder, from which every executor, also a
    later one, can fetch it.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(root)))
    target = f"{shared_folder(spark)}/pacelane-code/{context.applicationId}/pacelane.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
