"""Small files and folders on whatever file system a path names (local, HDFS, object stores), through Hadoop's interface."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return bool(fs.exists(at))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it isn't there."""
    at, fs = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _path(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file, flushes, and renames over it in one step; only the owner may read it where the file system has such rights."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, fs = _path(spark, path)
    fs.mkdirs(at.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(beside)
    try:
        stream.write(bytearray(text.encode("utf-8")))
        stream.hsync()
    finally:
        stream.close()
    fs.setPermission(beside, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(at), options)


def private_folder(spark: SparkSession, path: str) -> None:
    """Makes a folder that only its owner may enter."""
    at, fs = _path(spark, path)
    fs.mkdirs(at)
    fs.setPermission(at, spark._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))
