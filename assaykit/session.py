"""Session set-up and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "assaykit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; everything else is left to the cluster's defaults."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a ``local`` master may fall back to a temporary folder, since there every
    task runs on the one machine that owns it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    already_set = spark.sparkContext.getCheckpointDir()
    if already_set:
        return already_set
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="assaykit-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application so it is easy to expire."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/assaykit-{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    This cuts the lineage on storage that outlives any executor, and it fixes values such as
    partition ids that would differ if the plan were run a second time.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that no later plan reads."""
    spark = table.sparkSession
    own = f"assaykit-{spark.sparkContext.applicationId}/"
    folders = {f.rpartition("/")[0] for f in table.inputFiles()}
    for folder in folders:
        if own not in folder:
            raise ValueError(f"{folder} is not an intermediate table of this application")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after the row count was seen to be within ``max_rows``.

    ``df`` should be cheap to count (aggregates of a materialized table). Beyond the bound the
    frame is returned without a hint and the join shuffles as usual.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
