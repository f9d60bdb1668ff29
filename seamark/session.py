"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the library wants when it starts a session itself; a given session is used as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str, app: str = "seamark", **conf: str) -> SparkSession:
    """Start a session on ``master`` with the library's defaults and ``conf`` on top."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session gets a temporary folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="seamark-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    In a loop, ``instead_of`` is the checkpoint of the round before; its files are deleted when the new one is written.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing needs any more; anything else is left alone."""
    try:
        path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    except Exception:  # no checkpoint
        return
    if path.isDefined():
        delete(df.sparkSession, path.get())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared storage."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def lay_out(df: DataFrame, *keys: str) -> DataFrame:
    """Checkpoint of ``df`` that is hash partitioned and sorted by ``keys``, and known to be, so that windows, groups and joins over them need no exchange."""
    return keep_layout(df.repartition(parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys))


def keep_layout(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``cut_lineage`` that remembers how the rows are partitioned and sorted.

    Adaptive planning would hide the layout, so it is off while this one plan runs.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df, instead_of)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session works with."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def store(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a compressed columnar table in the shared checkpoint folder.

    For large intermediate tables that are read several times by column; removed when the program ends.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """Path for a new table in the shared checkpoint folder, removed when the program ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session is gone; the folder's owner cleans up
            pass

    atexit.register(remove)
    return path
