"""Session helpers: one time zone, one shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app_name: str = "hazeflow", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with UTC, ANSI and adaptive execution switched on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites of every column expression cost more than building the plan does.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return pin_utc(builder.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """All event times are UTC; make hour, day and epoch functions agree with that."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediates, stream checkpoints and tables.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``.
    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = spark.conf.get("spark.hazeflow.local.dir", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="hazeflow-")
            spark.conf.set("spark.hazeflow.local.dir", base)
    return f"{base.rstrip('/')}/hazeflow/{purpose}-{uuid.uuid4().hex}"


def materialize(df, purpose: str):
    """Write ``df`` once to the shared folder and read it back.

    For results that several actions use: the readers then share one computation
    and do not depend on any executor's memory or local disk.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
