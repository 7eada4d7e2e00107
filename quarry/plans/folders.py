"""Folders of Hadoop's file systems, from the driver: presence, moves, lists, and files that are created once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def fs_of(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = fs_of(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = fs_of(spark, path)
    fs.delete(at, True)


def make(spark: SparkSession, path: str) -> None:
    at, fs = fs_of(spark, path)
    fs.mkdirs(at)


def move(spark: SparkSession, a: str, b: str) -> None:
    """Renames a folder; b must not be there."""
    at, fs = fs_of(spark, a)
    to, _ = fs_of(spark, b)
    if fs.exists(to) or not fs.rename(at, to):
        raise OSError(f"{a} could not be renamed {b}")


def entries(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in a folder and when they changed (milliseconds); none if it is not there."""
    at, fs = fs_of(spark, path)
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at)) if fs.exists(at) else []


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a whole file at path in one step; False, and nothing changed, if there is one already."""
    at, fs = fs_of(spark, path)
    beside, _ = fs_of(spark, f"{at.getParent()}/.{at.getName()}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        # without options an existing file is never replaced
        context.rename(beside, at, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:  # noqa: BLE001  the gateway's own class
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def content(spark: SparkSession, path: str) -> str:
    at, fs = fs_of(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def named(spark: SparkSession, root: str, names: tuple[str, ...], depth: int) -> list[str]:
    """Files of these names below a folder, relative to it, `depth` levels deep at most. The file system matches them level by level."""
    at, fs = fs_of(spark, root)
    base, out, level = fs.makeQualified(at).toString().rstrip("/") + "/", [], root.rstrip("/")
    for _ in range(depth):
        for name in names:
            found, _ = fs_of(spark, f"{level}/{name}")
            out += [s.getPath().toString().removeprefix(base) for s in fs.globStatus(found) or [] if s.isFile()]
        level += "/*"
        deeper, _ = fs_of(spark, level)
        if not any(s.isDirectory() for s in fs.globStatus(deeper) or []):
            break
    return sorted(out)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder and below."""
    at, fs = fs_of(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0
