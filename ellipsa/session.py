"""Session helpers shared by tests, the bench and scripts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ellipsa")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one for a local session, and an error on a cluster, whose machines share none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ellipsa-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written by each application and not deleted yet.
_written: dict[str, list[str]] = {}


def _file_system(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def own_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/ellipsa-{app}"
    if app not in _written:
        _written[app] = []
        system, where = _file_system(spark, path)
        system.mkdirs(where)
        system.deleteOnExit(where)
    return path


def materialise(df: DataFrame, name: str = "table", kept: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    The lineage ends there, so a lost executor costs one task, not the whole chain. The table lasts until the driver ends or, if it isn't ``kept``, until
    the ``scratch`` block that it was written in does.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not kept:
        _written[spark.sparkContext.applicationId].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were materialised within the block and aren't kept; what is needed of them must have been written by then."""
    own_dir(spark)
    written = _written[spark.sparkContext.applicationId]
    first = len(written)
    try:
        yield
    finally:
        for path in written[first:]:
            system, where = _file_system(spark, path)
            system.delete(where, True)
        del written[first:]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
