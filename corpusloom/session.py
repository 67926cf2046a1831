"""Session helpers shared by every operator: tables, lineage cuts, name hygiene."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parent.parent)


def build_session(cpus: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go when nothing needs them
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    share_package(spark)
    return spark


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed (local runs)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if REPO not in paths:
        env["PYTHONPATH"] = ":".join([REPO, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path is only ever opened by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or else the context's checkpoint folder: driver and executors share it.

    Only a local session may fall back to a temporary folder: on a cluster executors could
    not read each other's files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if (chosen := spark.sparkContext.getCheckpointDir()) is not None:  # set on the context instead
        return chosen.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="corpusloom-")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of so many bytes for what follows in the session: a batch of long texts, cut into words, is many times its size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own under the shared folder, deleted at the end: what leaves the block must be written elsewhere."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        drop_folder(spark, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows as a compressed table at ``path``."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of ``df`` has, also not in another case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def is_train(column: str, buckets: int) -> F.Column:
    """The fixed split of the contracts: crc32 of the id as text, remainder not 0."""
    return F.crc32(F.col(column).cast("string")) % buckets != 0
