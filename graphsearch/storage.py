"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_roots: dict[str, tuple[SparkSession, str]] = {}


def folder(spark: SparkSession) -> str:
    """This application's own folder under spark.checkpoint.dir, removed at its end; a temporary one where that is unset and all runs on this machine."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        top = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
        if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_SETTING} is unset: intermediate tables need a folder that all machines share")
        _roots[app] = (spark, f"{top or 'file://' + tempfile.mkdtemp(prefix='graphsearch-')}/tables-{app}")
        atexit.register(_remove, app)
    return _roots[app][1]


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def _remove(app: str) -> None:
    spark, root = _roots.pop(app)
    if getattr(spark.sparkContext, "_jsc", None) is None:
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have gone first; the folder then stays
        return


def stored(df: DataFrame) -> DataFrame:
    """df, written and read again: its lineage ends there, and any executor can read it."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
