"""Session defaults and the shared folder for results that are written once and read again."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagemill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. A session in one process, as in tests, may go
    without and gets a new folder of its machine; on a cluster that is an error, since executors would not find each
    other's files."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(sc, "_pagemill_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="pagemill-", dir=os.environ.get("TMPDIR"))
        sc._pagemill_dir = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; within scratch it is deleted at the end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for written in getattr(spark.sparkContext, "_pagemill_scratch", []):
        written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the plan so far runs once, and a lost executor
    costs no more than a file read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what materialize wrote inside; the results must have been written or collected by then."""
    sc = spark.sparkContext
    stack = sc.__dict__.setdefault("_pagemill_scratch", [])
    written: list[str] = []
    stack.append(written)
    try:
        yield
    finally:
        stack.remove(written)
        for path in written:
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
