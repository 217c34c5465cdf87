"""Edges from a file stream, absorbed batch by batch.

State lives in Parquet tables, one version for each batch id, so a batch that
Structured Streaming hands over again after a failure starts from the version
before it and gives the same tables. The last two versions are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from triadic.operators.incremental import State, absorb, bootstrap
from triadic.sources.edge_list import SCHEMA

TABLES = ("vertices", "edges", "supported", "triangles")


def save(state: State, path: str, version: int) -> None:
    for name in TABLES:
        getattr(state, name).write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
    state.vertices.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/v{version}/complete")


def load(spark: SparkSession, path: str, version: int) -> State:
    return State(*(spark.read.parquet(f"{path}/v{version}/{name}") for name in TABLES))


def complete(spark: SparkSession, path: str, version: int) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{version}/complete/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def begun(spark: SparkSession, path: str) -> bool:
    """Whether there is a complete version."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/complete/_SUCCESS")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def forget(spark: SparkSession, path: str, version: int) -> None:
    """Removes a version, if there is one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{version}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def edge_stream(spark: SparkSession, path: str, sep: str = " ", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA).option("sep", sep)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path)


def start(stream: DataFrame, bulk: DataFrame, state_path: str, checkpoint: str, n_rounds: int = 5, available_now: bool = True) -> StreamingQuery:
    """Starts absorbing ``stream`` (src, dst) on top of ``bulk`` (symmetric edges). Version 0 is the bulk, version k + 1 follows batch k."""
    spark = stream.sparkSession
    if not begun(spark, state_path):
        save(bootstrap(bulk), state_path, 0)

    def step(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        if not complete(own, state_path, batch_id + 1):
            save(absorb(load(own, state_path, batch_id), batch, n_rounds), state_path, batch_id + 1)
        forget(own, state_path, batch_id - 1)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
