"""Session settings and the shared folder for materialised intermediate results."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and estimated bytes up to which a fitted table may travel through the driver and be broadcast.
SMALL_ROWS = 50_000
SMALL_BYTES = 16 << 20
#: Methods above this size are not compiled by the JIT; wide projections then run faster operator by operator.
HUGE_METHOD = 8000


def build_session(app: str = "riskframe", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution on; every setting can be overridden by ``conf``
    (dots in option names are written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.codegen.hugeMethodLimit": str(HUGE_METHOD),
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, whatever their working directory."""
    folder = Path(__file__).resolve().parent
    name = f"{folder.name}.zip"
    if not any(f.endswith(f"/{name}") for f in spark.sparkContext.listFiles):
        zipped = shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/{folder.name}", "zip", folder.parent, folder.name)
        spark.sparkContext.addPyFile(zipped)


@contextlib.contextmanager
def set_for_now(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A session setting for the jobs started inside; the caller's own comes back at the end."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a temporary folder; on a
    cluster each executor would write to a disk of its own, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="riskframe-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _bytes(df: DataFrame) -> Column:
    """Estimated size of a row: the length of texts and nested values, 8 for other types."""
    parts = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) if t == "string" or "<" in t else F.lit(8)
             for c, t in df.dtypes]
    return sum(parts, F.lit(16)).cast("long")


def settle(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """Run a fitted (aggregated) table once and say whether it is small.

    Up to ``limit`` rows (SMALL_ROWS) and SMALL_BYTES it comes back as a local relation, so later
    uses neither recompute it nor guess its size. Its size is known before any row is fetched: a
    larger table never reaches the driver, it is written to the shared folder and the caller joins
    it with a shuffle. The cache in between only spares the second computation; a lost executor
    costs time, not rows.
    """
    limit = SMALL_ROWS if limit is None else limit
    own_cache = df.storageLevel == StorageLevel.NONE  # a cache of the caller stays
    kept = df.persist(StorageLevel.MEMORY_AND_DISK) if own_cache else df
    try:
        size = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(_bytes(kept)), F.lit(0)).alias("b")).first()
        if size["n"] <= limit and size["b"] <= SMALL_BYTES:
            return df.sparkSession.createDataFrame(kept.toArrow(), schema=df.schema), True
        return stage(kept), False
    finally:
        if own_cache:
            kept.unpersist()


def stage(df: DataFrame) -> DataFrame:
    """Write a costly intermediate table to the shared folder and go on from the files."""
    path = fresh_path(df.sparkSession, "stage")
    with set_for_now(df.sparkSession, "spark.sql.codegen.hugeMethodLimit", HUGE_METHOD):  # also in sessions of others
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle tasks this session plans for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
