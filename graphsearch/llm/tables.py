"""Input tables, and intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_roots: dict[str, tuple[SparkSession, str]] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder under spark.checkpoint.dir; a temporary one where that is unset and all runs on this machine, as in tests."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        top = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
        if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_SETTING} is unset: intermediate tables need a folder that all machines share")
        root = f"{top or 'file://' + tempfile.mkdtemp(prefix='graphsearch-')}/graphsearch-{app}"
        _roots[app] = (spark, root)
        atexit.register(_remove, app)
    return _roots[app][1]


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
    """df, written to the shared folder and read again: its lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of a bounded size (the session's limit is lowered, never raised), whose worker gives back the memory that they took.

    Workers serve later stages, and would keep it beside what those need.
    """
    _bound_batches(df.sparkSession)

    def kept(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(kept, schema)


def _bound_batches(spark: SparkSession) -> None:
    now = spark.conf.get(_BATCH).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, id: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id is not among the values of gone's one column; rows without id stay, and so do all columns."""
    name = fresh(docs, "gone")
    return docs.join(stored(gone.toDF(name).distinct()), F.col(f"`{id}`") == F.col(f"`{name}`"), "left_anti")


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now.

    Spark removes them when the driver's garbage is collected, which a driver with little to do may not
    do for half an hour; the executors' disks would hold the shuffles of all steps until then.
    """
    for _ in range(2):  # what the first collection drops holds what the second can
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
