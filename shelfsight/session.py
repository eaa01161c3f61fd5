"""Session settings the operators rely on; all can be set on a live session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods above 8000 bytes of bytecode. Long text
    # projections are faster as several small methods than as one such method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # GBK and GB18030 exports are refused by the CSV reader without this.
    "spark.sql.legacy.javaCharsets": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a scratch one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        shared = tempfile.mkdtemp(prefix="shelfsight-checkpoint-")
    sc.setCheckpointDir(shared)
