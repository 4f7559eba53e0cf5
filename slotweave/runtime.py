"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "slotweave", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC, AQE and Arrow; settings of a running cluster session win."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below the folder ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    A session that already has a checkpoint folder keeps it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may do without; it gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (sc.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return named or tempfile.mkdtemp(prefix="slotweave-")
