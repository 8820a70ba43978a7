"""Lineage cuts in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset (tests,
a laptop) one is made up.  Nothing here is kept on a single executor, so a lost
executor costs a re-read, not the job.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "/tmp/checkpoints/knotwork"
_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set as the context's checkpoint directory too."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an iteration's state; keeps the state's partitioning."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(df: DataFrame) -> None:
    """Delete the files of a ``checkpoint`` that a later one has replaced, so that a loop holds two of
    them at most; nothing is done for other frames."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.getClass().getSimpleName().startswith("LogicalRDD"):
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once as compressed Parquet in the shared folder and read it back.

    For wide intermediate results that several later steps read: columnar, compressed,
    and with real sizes for the planner, unlike a checkpoint's serialised rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/knotwork-{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(sweep)
    _made[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def written() -> set[str]:
    """The tables that exist now; pass it to ``release`` later."""
    return set(_made)


def release(before: set[str], *keep: DataFrame) -> None:
    """Delete the tables written since ``before``, but for those given: what an operator's result
    no longer reads once its last tables are written."""
    kept = {df._scratch for df in keep}
    for path in [p for p in _made if p not in before and p not in kept]:
        _delete(path, _made.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep() -> None:
    """Delete the tables that this driver has left."""
    while _made:
        path, spark = _made.popitem()
        try:
            _delete(path, spark)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder then stays
            continue
