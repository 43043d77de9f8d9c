"""Cutting lineage through written tables in storage that all executors share.

``cut`` writes a DataFrame as Parquet below the folder named by ``spark.checkpoint.dir``
and returns the read of it. The data survive the loss of executors, the optimizer sees the
real size (which decides broadcasts), and later steps don't repeat the work above.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_written: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and Spark runs
    in one process (tests, benches) a temporary folder is made; on a cluster without the
    setting this raises, since executors could not see a folder of one machine.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get(_KEY, None) or spark.conf.get(_KEY, None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tessellum-")
        base = f"file://{_own[app]}"
    return f"{base.rstrip('/')}/tessellum-{app}"


def new_path(spark: SparkSession, name: str = "cut") -> str:
    """An unused path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    paths = _written.setdefault(spark.sparkContext.applicationId, set())
    if not paths:
        atexit.register(_clean, spark)
    paths.add(path)
    return path


def cut(df: DataFrame, name: str = "cut", clean: bool = False) -> DataFrame:
    """``df`` computed once, written, and read again. With ``clean`` its shuffle files are
    deleted as soon as it is written, else when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    if clean:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessellum_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete what ``cut`` wrote for ``df``; nothing else may read it afterwards."""
    path = getattr(df, "_tessellum_path", None)
    if path:
        delete(df.sparkSession, path)
        _written.get(df.sparkSession.sparkContext.applicationId, set()).discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` wrote in this application, for long sessions: results not
    yet read or written elsewhere are lost."""
    for path in _written.get(spark.sparkContext.applicationId, set()):
        delete(spark, path)
    _written.get(spark.sparkContext.applicationId, set()).clear()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _clean(spark: SparkSession) -> None:
    try:
        app = spark.sparkContext.applicationId
        for path in _written.pop(app, set()):
            delete(spark, path)
    except Exception:  # the session is gone; its folder belongs to the cluster's clean-up
        pass
