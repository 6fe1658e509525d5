"""Sessions and lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster the caller brings its own."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true"}
    return SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, to a temporary one in local mode, an error on a cluster."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spanweave-checkpoint-"))
    return df.checkpoint(eager=True)
