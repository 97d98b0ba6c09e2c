"""Session set-up: the package's own code for Python workers, and written tables in the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Has the driver serve this package to executors, so that their Python workers can import it; once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="recordloom-")) / "recordloom_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def ship_to_active() -> None:
    """The same for the active session; column functions that run Python call it."""
    if spark := SparkSession.getActiveSession():
        ship_package(spark)


#: The lists that collect the work folders made in this thread's watched() blocks.
_watching: ContextVar[tuple[list[str], ...]] = ContextVar("watching", default=())
#: Work folders in use: path -> a weak reference to the JVM's list of its files, which every plan that reads it holds.
_used: dict[str, object] = {}


@contextmanager
def watched():
    """Collects the work folders that are made inside, by this thread."""
    made: list[str] = []
    token = _watching.set((*_watching.get(), made))
    try:
        yield made
    finally:
        _watching.reset(token)


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine (tests) may name none: it gets a folder under /tmp. On a cluster that would be another
    folder on each machine, so it is an error there. Folders that nothing reads any more are deleted here.
    """
    sweep(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    path = f"{base.rstrip('/')}/recordloom-{uuid.uuid4().hex}"
    for made in _watching.get():
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """A new folder below the work folder, deleted at the end."""
    path = work_dir(spark)
    try:
        yield path
    finally:
        delete(spark, path)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _folder(spark, path)
        fs.delete(p, True)
        _used.pop(path, None)


def sweep(spark: SparkSession) -> None:
    """Deletes the work folders that no plan of this application reads any more."""
    for path, files in list(_used.items()):
        if files.get() is None:
            delete(spark, path)


def read_work(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table in a work folder. The folder lives as long as any DataFrame derived from this one, and at most as long as the application."""
    df = spark.read.schema(schema).parquet(path)
    fs, p = _folder(spark, path)
    fs.deleteOnExit(p)
    if path not in _used:
        _used[path] = spark._jvm.java.lang.ref.WeakReference(df._jdf.queryExecution().analyzed().relation().location())
    return df


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots as __) that hold inside; the session's own come back after."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: what follows doesn't depend on executors' disks.

    The shuffle files of that one write go with its end.
    """
    spark = df.sparkSession
    path = path or work_dir(spark)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.options(**options).parquet(path)
    return read_work(spark, path, df.schema)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what materialize() wrote for these frames now, not when nothing reads it any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(spark, *[p for p in _used if _plain(p) == _plain(folder)] or [folder])


def _plain(path: str) -> str:
    return re.sub("^file:/*", "/", path.rstrip("/"))
