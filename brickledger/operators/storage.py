"""Materialising an intermediate result in shared storage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

class _Scopes(threading.local):
    """Folders to delete when a scope of ``scratch`` ends, the innermost last; a stream's batches have their own."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def shared_folder(spark: SparkSession) -> str:
    """The folder or URI named by ``spark.checkpoint.dir``; one in the local temporary folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{tempfile.gettempdir()}/brickledger-{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str = "stored") -> str:
    """A path below the shared folder that nothing has used yet; a scope of ``scratch`` deletes it at its end."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    A result that is used more than once is then computed once, and a lost
    executor costs a re-read instead of the whole lineage.  Unlike a
    checkpoint, the table is columnar: each use reads only its own columns.
    Inside ``with scratch(spark):`` the table goes when the block ends.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever file system it is on."""
    _file_system(spark, path).delete(_hadoop_path(spark, path), True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, folder = _file_system(spark, path), _hadoop_path(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(folder)) if fs.exists(folder) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    stream = _file_system(spark, path).open(_hadoop_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file that appears whole or not at all; false, and no change, if there is one already."""
    jvm, staged = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}"
    stream = _file_system(spark, path).create(_hadoop_path(spark, staged), True)
    stream.write(bytearray(content.encode()))
    stream.close()
    # the default file system if the path has no scheme
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _file_system(spark, path).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_hadoop_path(spark, staged), _hadoop_path(spark, path), no_options)
        return True
    except Exception as error:
        remove(spark, staged)
        if "FileAlreadyExistsException" not in str(error):
            raise
        return False


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Put the finished folder ``staged`` in the place of ``path``; until then what was there stays."""
    fs = _file_system(spark, path)
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    replaced = fs.exists(_hadoop_path(spark, path))
    if replaced and not fs.rename(_hadoop_path(spark, path), _hadoop_path(spark, old)):
        raise OSError(f"{path} cannot be moved aside")
    if not fs.rename(_hadoop_path(spark, staged), _hadoop_path(spark, path)):
        if replaced:
            fs.rename(_hadoop_path(spark, old), _hadoop_path(spark, path))
        raise OSError(f"{staged} cannot be moved to {path}")
    if replaced:
        fs.delete(_hadoop_path(spark, old), True)


@contextmanager
def replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """A sibling folder to write to; it takes the place of ``path`` if the block succeeds and goes if it fails."""
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    try:
        yield staged
        publish(spark, staged, path)
    finally:
        remove(spark, staged)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block what ``stored`` and ``new_path`` made in it.

    Use results inside the block, or write them first: a DataFrame that reads
    a deleted table can no longer be evaluated.
    """
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            remove(spark, path)
