"""Tables written to the folder that all executors share, to cut lineage.

``spark.checkpoint.dir`` of the session names that folder.  Only a session in
local mode without the setting (tests) gets a temporary one.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}
_WATCHED: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    already = context._jsc.sc().getCheckpointDir()
    if already.isDefined():
        return already.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = Path(_scratch("treeloom-")).as_uri()
    return _LOCAL_DIR[app]


def _scratch(prefix: str) -> str:
    """A folder of the driver that goes with its process."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/treeloom-{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The result has no lineage before the written files, so losing an executor
    costs nothing that came earlier.  The files go with the driver's JVM, unless
    :func:`release` deletes them before.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._staged_in = path
    for tables in _WATCHED:
        tables.append(stored)
    return stored


#: Rows of ids that are sent to all executors.
FEW = 200_000


def few(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored, and marked to be broadcast if it has at most ``FEW`` rows."""
    stored = materialize(df, label)
    return stored.hint("broadcast") if stored.count() <= FEW else stored


@contextmanager
def staged() -> Iterator[list[DataFrame]]:
    """The tables that :func:`materialize` writes inside the block."""
    tables: list[DataFrame] = []
    _WATCHED.append(tables)
    try:
        yield tables
    finally:
        _WATCHED.pop()


def _folders(df: DataFrame) -> list:
    """The staged folders that a table reads, as pairs of file system and path."""
    context = df.sparkSession.sparkContext
    conf = context._jsc.hadoopConfiguration()
    own = vars(df).get("_staged_in")
    names = {own} if own else {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    paths = [context._jvm.org.apache.hadoop.fs.Path(f) for f in names if "/treeloom-" in f]
    return [(p.getFileSystem(conf), p) for p in paths]


def exists(df: DataFrame) -> bool:
    """Whether all files of a table that :func:`materialize` wrote are still there."""
    return all(fs.exists(path) for fs, path in _folders(df))


def release(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote, when its last reader is done."""
    for fs, path in _folders(df):
        fs.delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run."""
    context = spark.sparkContext
    if _SHIPPED.get(context.applicationId):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(_scratch("treeloom-pkg-")) / "treeloom_pkg.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, os.path.join(root.name, source.relative_to(root)))
    context.addPyFile(str(target))
    _SHIPPED[context.applicationId] = str(target)
