"""Sessions, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "corpusfreq") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, spark-submit settings take its place."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores where its scan has fewer partitions than that, as files of one row group have; large inputs are left as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def pieces(df: DataFrame, mb: int = 8) -> int:
    """Partitions for the tokens of df: one for so many MB of its files, as many as cores at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, min(4096, size // (mb << 20)))


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster sets it, else a folder of
    this machine (local mode only, where driver and executors are one process)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            root = set_already.get()
        elif spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="corpusfreq-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_MADE: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; what is left there is deleted when this process ends."""
    path = f"{scratch_root(spark)}/corpusfreq-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.add(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables so far; results that weren't written elsewhere can't be read any more. For drivers that live long."""
    for path in list(_MADE):
        drop_path(spark, path)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        clear(spark)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; later reads of tables in it fail."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.discard(path)


def collect_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are written; they stay on disk until both languages of the driver collect their garbage."""
    for _ in range(2):  # what the first round frees lets go of more
        gc.collect()
        if spark.sparkContext._jvm is not None:
            spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cut lineage with a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
