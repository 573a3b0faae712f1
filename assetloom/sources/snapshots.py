"""Tables published as snapshots: a folder for each state and a small pointer file that names the one to read.

A writer fills a new folder and then replaces the pointer by a rename, which a file system does whole or not at all. A run
that fails before leaves the old state readable; readers that began before keep their folder, as one superseded snapshot
stays until the next is published."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the snapshot that the pointer names, or None where there is no pointer."""
    fs, where = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def folder(spark: SparkSession, root: str) -> str:
    """Where the current state lies: below the pointer's snapshot, or ``root`` itself where nothing was published."""
    name = current(spark, root)
    return root if name is None else f"{root}/{name}"


def fresh(root: str) -> tuple[str, str]:
    """(name, folder) of a snapshot to be written."""
    name = f"snapshot-{uuid.uuid4().hex}"
    return name, f"{root}/{name}"


def publish(spark: SparkSession, root: str, name: str, clear: bool = True) -> None:
    """Readers see the snapshot from now on. With ``clear`` those before the one it replaces are removed."""
    was = current(spark, root)
    fs, temporary = _fs(spark, f"{root}/_{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(name.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    over[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(temporary), fs.makeQualified(jvm.Path(f"{root}/{POINTER}")), over)
    if clear:
        for status in fs.listStatus(jvm.Path(root)):
            other = status.getPath().getName()
            if other.startswith("snapshot-") and other not in (name, was):
                fs.delete(status.getPath(), True)


def write(df: DataFrame, root: str, by=()) -> None:
    """``df`` as the new state below ``root``, partitioned by the given columns."""
    name, path = fresh(root)
    df.write.partitionBy(*by).parquet(path)
    publish(df.sparkSession, root, name)


def clear(spark: SparkSession, folders: list[str], keep: str) -> None:
    """Removes the snapshots' folders below the given ones but one."""
    for root in folders:
        fs, where = _fs(spark, root)
        for status in fs.listStatus(where) if fs.exists(where) else ():
            if status.getPath().getName() != keep:
                fs.delete(status.getPath(), True)


def keep_only(spark: SparkSession, root: str, names) -> None:
    """Removes the folders below ``root`` that aren't named."""
    fs, where = _fs(spark, root)
    for status in fs.listStatus(where) if fs.exists(where) else ():
        if status.getPath().getName() not in names:
            fs.delete(status.getPath(), True)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)
