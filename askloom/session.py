"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cores: int | str = "*", app: str = "askloom", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    slots = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(max(slots or 1, 1)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = str(Path(tempfile.mkdtemp(prefix="askloom-zip-")) / package.name)
    archive = shutil.make_archive(target, "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` as the session has it.

    Only a local master may go without the setting; it then gets one temporary
    folder per application. A cluster without the setting is an error, because
    a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="askloom-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder.

    Everything one application stores lies in one subfolder named after it;
    ``drop_scratch`` removes it.
    """
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reads."""
    context = spark.sparkContext
    file = context._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(context._jsc.hadoopConfiguration()).exists(file)


def drop_scratch(spark: SparkSession) -> None:
    """Remove everything this application stored below the shared folder.

    For a long-lived application between its jobs, and for any at its end: DataFrames that read stored
    tables cannot be used afterwards.
    """
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{context.applicationId}")
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Settings of the session that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """Inside the block every write or action deletes its shuffle files as it ends.

    Otherwise they lie on disk until the driver happens to collect its garbage.
    """
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


@contextmanager
def scratch_scope(spark: SparkSession):
    """Stored tables live as long as the block: write or collect results inside it."""
    try:
        yield
    finally:
        drop_scratch(spark)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` stored; it cannot be read any more."""
    context = df.sparkSession.sparkContext
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, survives lost executors, and
    unlike a checkpoint still lets later reads prune columns and push filters.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
