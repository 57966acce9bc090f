"""Session settings and the shared folder in which intermediate tables are cut from their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # aggregates of lists for as many groups as this stay in a hash table; with more they are sorted
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
    "spark.ui.enabled": "false",
    # reports build hundreds of column expressions; do not record a call site for each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int = 8, **settings: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("daygrain")
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "8g",
        # test tables are small: do not merge their partitions into one task
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        **settings,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, named by ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="daygrain-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder, so that later steps do not recompute their inputs."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
