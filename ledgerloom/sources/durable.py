"""Intermediates that survive the loss of an executor.

Written as Parquet below the folder that the session names in
``spark.checkpoint.dir`` (on a cluster a shared one). Where the setting is
absent a local session, as in tests, uses a temporary folder of this machine; on a
cluster that is an error, for executors would each write to their own disk.
Everything a session wrote is removed when its driver ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The session's folder for intermediates."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        _roots[app] = f"{base.rstrip('/')}/ledgerloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        delete_path(spark, root)
    except Exception:  # the session may have been stopped before
        pass


def _located(spark: SparkSession, path: str):
    """A path and the file system it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is in; a missing one is fine."""
    p, fs = _located(spark, path)
    fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _located(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; a missing one has none."""
    p, fs = _located(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    p, fs = _located(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that appears whole or not at all; False if there is one already."""
    p, fs = _located(spark, path)
    part, _ = _located(spark, f"{path}.{uuid.uuid4().hex[:8]}.part")
    stream = fs.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = not fs.exists(p) and fs.rename(part, p)
    if not done:
        fs.delete(part, False)
    return done


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later uses neither recompute it nor
    see other partition numbers or other random order than the first. What was shuffled
    for it leaves the disks at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)
