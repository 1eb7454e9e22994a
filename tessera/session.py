"""Session builder with the settings the engine is tuned for, and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC time; ``conf`` overrides (dots as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table of ``sf_dir`` by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
