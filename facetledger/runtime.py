"""Session helpers: time zone, shared checkpoint folder, staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "facetledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect. Cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Timestamps are stored in UTC; local dates always come from an explicit zone argument."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@contextmanager
def setting(spark: SparkSession, **values: str | int) -> Iterator[None]:
    """Session settings for the jobs that run inside the block; those from before hold again when it ends."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="facetledger-checkpoint-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints: the cluster's setting, or a temp folder on local[*]."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


_STAGED: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are staged inside the block when it ends. What is returned from it must not read them."""
    before = len(_STAGED)
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for name in _STAGED[before:]:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _STAGED[before:]


def stage(df: DataFrame, by: str | None = None, buckets: int = 1) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared checkpoint folder and read them back.

    A lost executor does not redo the job, later steps read only the columns they need, and the planner sees real
    sizes. (``checkpoint()`` keeps the size estimate of the plan it cut, which grows with every join behind it.) ``by``:
    the column whose buckets the rows are written in; groups, windows and joins with this column among their keys then
    move no rows. The catalog has the table only while it is written.
    """
    spark = df.sparkSession
    number = uuid.uuid4().hex
    path = f"{checkpoint_dir(spark).rstrip('/')}/facetledger-{number}"
    _STAGED.append(path)
    if by is None:
        df.write.parquet(path, compression="zstd")
        return spark.read.schema(df.schema).parquet(path)
    name = f"facetledger_{number}"
    df.write.bucketBy(buckets, by).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return written
