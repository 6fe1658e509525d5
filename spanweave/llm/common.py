"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that are worked on at a time, and bytes of a batch where Spark's own bound is not set.
SLICE_ROWS, BATCH_BYTES = 1024, 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanweave-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that lost executors cost no recomputation of what came before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes: Spark's default of 64 MiB is lowered, a bound that the user set stays."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``SLICE_ROWS`` rows, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_texts(df: DataFrame, fn: Callable[[list], dict], schema: str) -> DataFrame:
    """Apply ``fn`` to lists of the columns of ``df``; it returns lists by the names in ``schema``."""
    arrow = df.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in arrow}, schema=arrow)

    return bounded(df).mapInArrow(run, schema)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8; ``bytes.split`` parts at exactly these six characters."""
    return text.encode().split() if text else []


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def materialize(df: DataFrame) -> DataFrame:
    """Like checkpoint(), but as compressed Parquet, for tables that grow with the corpus."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate files, which must exist, when the driver ends; results may be read from it until then."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
