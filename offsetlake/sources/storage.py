"""Paths and the few file-system calls that Spark's readers and writers do not cover.

All of them go through Hadoop's file-system classes, so they work on whatever shared storage the
path names.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from offsetlake.operators.skew import pin


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root(spark.sparkContext.applicationId)


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"offsetlake-{application}-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def overwriting(rows: DataFrame) -> DataFrameWriter:
    """A writer that replaces all of its target, whatever overwrite mode the session has."""
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "static")


def written(rows: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back."""
    path = work_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def settled(control: DataFrame, name: str = "control") -> DataFrame:
    """Evaluate a control table once: held as a local relation if small, else written."""
    side = pin(control)
    return written(control, name) if side is None else side


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _local(spark: SparkSession, path: str) -> Path | None:
    """The path on a file system that this process has mounted too, or None.

    Hadoop's local file system starts a shell for each link status and permission, some 20 ms each.
    """
    if re.match("file:/([^/]|//)", path):
        return Path("/" + path.removeprefix("file:").lstrip("/"))
    if not path.startswith("/"):
        return None
    return Path(path) if spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:/") else None


def exists(spark: SparkSession, path: str) -> bool:
    local = _local(spark, path)
    if local is not None:
        return local.exists()
    fs, target = _fs(spark, path)
    return fs.exists(target)


def has_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target) and any(
        status.getPath().getName().endswith(suffix) for status in fs.listStatus(target)
    )


def has_children(spark: SparkSession, path: str) -> bool:
    """Is there anything in the directory? Looks at its first entry only."""
    fs, target = _fs(spark, path)
    return fs.exists(target) and fs.listStatusIterator(target).hasNext()


def children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, in the form that scans report."""
    fs, target = _fs(spark, path)
    return fs.makeQualified(target).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or directory; nothing happens if it is gone."""
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small control file, or None."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def _linked(target: Path, text: str) -> bool | None:
    """Publish by a hard link: False if the name is taken, None on a file system without links."""
    if target.exists():
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
    try:
        with staged.open("x", encoding="utf-8", newline="") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.link(staged, target)
        return True
    except FileExistsError:
        return False
    except OSError:
        return None
    finally:
        staged.unlink(missing_ok=True)


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small control file so that it appears whole or not at all.

    Returns False, changing nothing, if the path exists already. The text is staged beside the
    target and renamed without overwriting, which decides between concurrent writers. On a mounted file
    system it gets its second name by a hard link, which never overwrites either.
    """
    local = _local(spark, path)
    if local is not None:
        linked = _linked(local, text)
        if linked is not None:
            return linked
    fs, target = _fs(spark, path)
    if fs.exists(target):
        return False
    hadoop = spark._jvm.org.apache.hadoop.fs
    staged = hadoop.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(staged, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    context = hadoop.FileContext.getFileContext(
        target.toUri(), spark._jsc.hadoopConfiguration()
    )
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = getattr(hadoop.Options.Rename, "NONE")
    try:
        context.rename(staged, target, options)
    except Exception:
        fs.delete(staged, False)
        if fs.exists(target):
            return False
        raise
    return True
