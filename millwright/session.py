"""Session set-up and lineage control."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Options a job relies on for right results; the rest is the cluster's business.
REQUIRED_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

TUNING_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the options every operator relies on to a session somebody else built."""
    for key, value in REQUIRED_OPTIONS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "millwright", **extra: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
    )
    for key, value in {**REQUIRED_OPTIONS, **TUNING_OPTIONS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session, where all of them are one process, may do without: it gets one
    temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="millwright-checkpoint-")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and go on from that table.

    It survives the loss of any executor, and unlike a checkpointed plan it has
    statistics, so later joins can still be planned by size.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote, once nothing that is still to be computed reads them.

    Frames of other origin are left alone.
    """
    for table in tables:
        path = getattr(table, "written_to", None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Place rows by key over the full number of shuffle partitions.

    For groups that are small in bytes but heavy to compute: without an explicit
    count they would be packed into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def deal_rows(df: DataFrame, rows: int, *keys: str, per_task: int = 500_000) -> DataFrame:
    """Place ``rows`` rows by key over the shuffle partitions, and over more of them where a task would hold over ``per_task`` rows."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task)), *keys)


def spread(scan: DataFrame) -> DataFrame:
    """Deal a plain scan out over the cores when it arrives in fewer splits than that.

    Only for row-wise heavy work: a large table has more splits than cores and is
    returned as it is, so this never shuffles one.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
