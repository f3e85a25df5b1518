"""Spark session and the shared folder that cut-off points are written to.

The folder is the session's ``spark.checkpoint.dir``. Where none is set, a local master gets a scratch folder of its
own, which is removed at the end, and any other master is refused.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "tillbook", master: str | None = None, partitions: int | None = None, shared: str | None = None
) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a scratch folder only for local masters."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if sc.applicationId not in _local_dirs:
            _local_dirs[sc.applicationId] = scratch = tempfile.mkdtemp(prefix="tillbook-")
            atexit.register(shutil.rmtree, scratch, ignore_errors=True)
        folder = _local_dirs[sc.applicationId]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and freezes row placement."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back, with pruning and statistics; ``options`` of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``stored``, in fewer bytes for some more CPU time: for what is written once and read as a library.

    With ``by`` in buckets by that column, as many as a shuffle has partitions: joins, sums and windows on it then read
    the table as it lies. All rows of a value lie in one bucket, so none may own a large share of them.
    """
    if by is None:
        return stored(df, name, compression="zstd")
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = uuid.uuid4().hex[:12]
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{mark}"
    table = f"{name}_{mark}".replace("-", "_")
    dealt = df.repartition(buckets, by).write.options(compression="zstd", path=path)
    dealt.bucketBy(buckets, by).sortBy(by).saveAsTable(table, format="parquet")
    return spark.table(table)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run inside, and the session's own one again afterwards."""
    own = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, own)
