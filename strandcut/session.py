"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when the frame that needs them does.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Image rows are large; keep one Arrow batch to a few hundred of them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def get_session(app: str = "strandcut", master: str | None = None, **conf: str) -> SparkSession:
    """Build or fetch a session with the defaults this package expects.

    On a cluster leave ``spark.sql.shuffle.partitions`` to the cluster's own
    settings; AQE merges small shuffle partitions and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset, only a
    master whose tasks run in the driver gets a temporary folder; any other
    must name a folder that all executors can reach.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="strandcut-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder
