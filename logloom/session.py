"""Session settings the operators rely on, and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.codegen.maxFields": "1000",  # the canonical event alone has more fields than the default lets into one generated stage
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",  # a ledger that lies by event meets results by event and destination where it lies
}

# Only settable when the session starts: call-site capture costs several round trips per column expression, and wide
# mappings hold thousands of them. Results are the same without it.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator assumes; safe to call again on the same session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "logloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the runtime options; `master` only for local runs, a cluster passes its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**START_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the folder all executors share (`spark.checkpoint.dir`).

    Only where that setting is missing, as in local tests, a local temporary folder is chosen and stored in the session; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/logloom/{label}-{uuid.uuid4().hex}"


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


WAVES = 4


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Repartition a CPU-bound job when its input has fewer partitions than the cluster has cores, and whenever it is read from files.

    A small file is one task whatever the work per row. Of a large one, cut into blocks, a row group is read whole by one task and the tasks of its other blocks get nothing, so the number of
    partitions says nothing about the rows in them; such rows are dealt out, over WAVES tasks a block. Other inputs that are spread already pass through untouched.
    """
    wanted = at_least or df.sparkSession.sparkContext.defaultParallelism
    found = df.rdd.getNumPartitions()
    if df.inputFiles():
        return df.repartition(max(wanted, WAVES * found))
    return df.repartition(wanted) if found < wanted else df
