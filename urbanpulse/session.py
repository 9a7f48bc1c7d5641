"""Session settings, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table on disk (compressed) that is broadcast.
BROADCAST_BYTES = 16 << 20


def utc(spark: SparkSession) -> SparkSession:
    """All clocks in the feeds are UTC; make the session agree."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: str = "*", app: str = "urbanpulse") -> SparkSession:
    """A session for tests and the benchmark; on a cluster use spark-submit settings instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="urbanpulse-checkpoint-"))
    return context.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders inside a folder; none if it does not exist."""
    system, target = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move a file or folder to a name that is free; False if the name is taken."""
    system, target = _file_system(spark, new)
    if system.exists(target):
        return False
    return system.rename(spark._jvm.org.apache.hadoop.fs.Path(old), target)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, whole."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    system, target = _file_system(spark, path)
    stream = system.create(target, True)
    stream.write(bytearray(data))
    stream.close()


def make_folder(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.mkdirs(target)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files in a folder; 0 if it does not exist."""
    system, target = _file_system(spark, path)
    if not system.exists(target):
        return 0
    return system.getContentSummary(target).getLength()


def written(df: DataFrame) -> str:
    """Write a table under a new name in the shared folder; returns its path."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: later branches and lost executors re-read it."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A join side computed once, and broadcast only when what was written is small.

    Above the limit it stays a plain table: the join shuffles and AQE splits hot keys.
    """
    spark, path = df.sparkSession, written(df)
    table = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(table) if path_bytes(spark, path) <= max_bytes else table


def spread(df: DataFrame) -> DataFrame:
    """Share out a small input over all cores before work that is heavy per row.

    A file with one row group is read by one task. Inputs with more partitions than cores,
    as on a cluster, are left as they are: nothing is exchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def beside(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Put a group table (one row per key) beside every row of its group; null keys match.

    The rows are not exchanged while the group table is small. Rows of groups without an entry stay if `how` is "left".
    """
    right = small_side(table).withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return df.join(right, reduce(lambda a, b: a & b, same), how).drop(*[f"_right_{k}" for k in keys])
