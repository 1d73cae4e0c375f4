"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app_name: str = "sugarline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library counts on.

    All event times are zone-less wall-clock values, hence the UTC session zone. Adaptive
    execution picks join strategies and partition counts from measured sizes.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the library to the executors, once for each application, so that Python code in tasks
    finds it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # The folder lives as long as the driver, which serves the file
    folder = os.path.realpath(tempfile.mkdtemp(prefix="sugarline-code-"))
    name = os.path.basename(package)
    context.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", os.path.dirname(package), name))
    _shipped.add(context.applicationId)


def _scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/sugarline-{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path below the application's folder in the cluster's shared one
    (``spark.checkpoint.dir``). Results read what stands there; :func:`clear_scratch` removes it.

    A local session without that setting uses a temporary folder. On a cluster each executor would
    write its own copy of such a folder, so there the setting is required.
    """
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application keeps in the shared folder, when its results are written."""
    remove(spark, _scratch_root(spark))


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A scratch path that is removed at the end of the block."""
    path = scratch_dir(spark, label)
    try:
        yield path
    finally:
        remove(spark, path)


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to a path that does not exist."""
    fs, old = _path(spark, source)
    _, new = _path(spark, target)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time in ms) of the files directly in a folder, by path."""
    fs, target = _path(spark, folder)
    found = [s for s in fs.listStatus(target) if s.isFile()] if fs.exists(target) else []
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found)


def list_folders(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the folders directly in a folder, in order."""
    fs, target = _path(spark, folder)
    found = [s for s in fs.listStatus(target) if s.isDirectory()] if fs.exists(target) else []
    return sorted(s.getPath().toString() for s in found)


def read_text(spark: SparkSession, path: str) -> str:
    """Content of a small file."""
    fs, target = _path(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file in one step: it is there whole or not at all. Fails if the path exists."""
    fs, target = _path(spark, path)
    beside = f"{target.getParent().toString()}/.{target.getName()}-{uuid.uuid4().hex}"
    _, staged = _path(spark, beside)
    stream = fs.create(staged)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise FileExistsError(path)
