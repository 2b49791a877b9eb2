"""A session with the settings the operators are planned for."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_shipped: set[str] = set()


def session(name: str = "passagekit", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling and coalescing; the rest as the cluster has it."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def workers_find_package(spark: SparkSession) -> None:
    """Python workers find this package: on this machine by its folder, on others by a zip of it in the shared folder, shipped once an application."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app in _shipped or master == "local" or master.startswith("local["):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        own = os.path.dirname(os.path.abspath(__file__))
        for folder, _, names in os.walk(own):
            for name in sorted(n for n in names if n.endswith(".py")):
                z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    path = f"{application_dir(spark)}/package-{uuid.uuid4().hex}.zip"
    p, fs = path_of(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, one below the warehouse.

    Only a session with a local master, whose tasks all run on this machine, gets a temporary folder, which goes
    when the driver ends.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/passagekit-scratch"
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="passagekit-")
        atexit.register(shutil.rmtree, _own_dir[app], ignore_errors=True)
    return "file://" + _own_dir[app]


def materialized(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read from there: what several steps read is worked out once."""
    path = f"{application_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Kept:
    """materialized() whose tables go together: with Kept() as keep, at the end of the block.

    For steps that write a result of their own, which no longer reads the tables.
    """

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{application_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
        self.tables.append((df.sparkSession, path))
        df.write.option("compression", "zstd").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_: object) -> None:
        for spark, path in self.tables:
            p, fs = path_of(spark, path)
            fs.delete(p, True)


def application_dir(spark: SparkSession) -> str:
    """The part of the shared folder that is this application's; clear_tables() deletes it."""
    return f"{shared_dir(spark)}/passagekit-{spark.sparkContext.applicationId}"


def path_of(spark: SparkSession, path: str):  # noqa: ANN201
    """The path and its file system, as Hadoop objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state_of(spark: SparkSession, path: str) -> str:
    """What tells a changed table from the one that was: its files' number and bytes, and when its folder changed."""
    p, fs = path_of(spark, path)
    now = fs.getContentSummary(p)
    return f"{now.getFileCount()} {now.getLength()} {fs.getFileStatus(p).getModificationTime()}"


def stored(spark: SparkSession, name: str, make: Callable[[str], None]) -> str:
    """The path of an index that make(path) writes; it is made once an application and then read by whoever asks for it."""
    path = f"{application_dir(spark)}/{name}"
    done, fs = path_of(spark, f"{path}/_made")
    if not fs.exists(done):
        make(path)
        fs.create(done, True).close()
    return path


def clear_tables(spark: SparkSession) -> None:
    """Deletes all tables of materialized() and stored(); for the end of a job, when no result still reads them."""
    path, fs = path_of(spark, application_dir(spark))
    fs.delete(path, True)
