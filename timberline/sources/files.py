"""Small files and folders beside the tables, by Hadoop's file systems."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def age_s(spark: SparkSession, path: str, now_s: float) -> float:
    fs, p = _at(spark, path)
    return now_s - fs.getFileStatus(p).getModificationTime() / 1000


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; none where there is no such file."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file whole; false, and nothing changed, where one of this name is there already."""
    draft = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    fs, p = _at(spark, draft)
    out = fs.create(p, False)
    out.write(bytearray(content.encode()))
    out.close()
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    to = jvm.org.apache.hadoop.fs.Path(path)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(p, to, none)
    except Py4JJavaError:
        fs.delete(p, False)
        if not fs.exists(to):
            raise
        return False
    return True
