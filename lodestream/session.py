"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lodestream", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; partition counts stay the cluster's unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it a local master gets a local one, a cluster an error.

    Executors would each write to a folder of their own machine, and reading it back would give a part of the rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "lodestream-checkpoints")
    return root.rstrip("/")


def switch(spark: SparkSession, aside: str, path: str) -> None:
    """Puts the written table ``aside`` in the place of ``path`` by renames; what was there stays as ``path``.old until then.

    A run that stops between the two renames leaves the old table under that name: ``settle`` brings it back.
    """
    fs, name = _files(spark, path)
    settle(spark, path)
    if fs.exists(name(path)):
        fs.rename(name(path), name(f"{path}.old"))
    if not fs.rename(name(aside), name(path)):
        settle(spark, path)
        raise OSError(f"{aside} could not be renamed to {path}")
    fs.delete(name(f"{path}.old"), True)


def settle(spark: SparkSession, path: str) -> bool:
    """Ends a switch that was interrupted; whether there is a table at ``path``."""
    fs, name = _files(spark, path)
    if fs.exists(name(f"{path}.old")):
        if fs.exists(name(path)):
            fs.delete(name(f"{path}.old"), True)
        else:
            fs.rename(name(f"{path}.old"), name(path))
    return bool(fs.exists(name(path)))


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path
    return name(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later stages start from files, not from lineage."""
    return written(df, name)[0]


def written(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, Callable[[], None]]:
    """``cut``, and what deletes its files when nothing reads them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)

    def drop() -> None:
        fs, at = _files(spark, path)
        fs.delete(at(path), True)

    return spark.read.schema(df.schema).parquet(path), drop


def reach(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, whatever their working folder.

    On a cluster the package comes by --py-files or is installed; a path that isn't there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def write_text_atomic(spark: SparkSession, path: str, text: str) -> None:
    """A file of the shared folder, written beside its place and renamed into it: a reader sees the old text or the new one."""
    fs, name = _files(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(name(aside), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(name(path)):
        fs.delete(name(path), False)
    if not fs.rename(name(aside), name(path)):
        raise OSError(f"{aside} could not be renamed to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    fs, name = _files(spark, path)
    if not fs.exists(name(path)):
        return None
    return spark.read.format("binaryFile").load(path).first()["content"].decode()
