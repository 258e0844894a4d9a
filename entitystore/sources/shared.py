"""The folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Where that folder is if a session on one machine names none.
OWN = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one of our own only if it is unset and all runs in this process."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = OWN
    return d.rstrip("/")
