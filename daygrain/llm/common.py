"""Helpers shared by the operators: shared storage, distribution of the code, connected components."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import daygrain
from daygrain.session import checkpoint_folder, cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a copy in the shared checkpoint folder, which lost executors cannot take along."""
    return cut_lineage(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows reread from a Parquet table in a new folder beside the checkpoints."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}/{name}.parquet"
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


@functools.cache
def _archive() -> str:
    """A zip of this package, made once in the driver's process."""
    root = os.path.dirname(os.path.abspath(daygrain.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="daygrain-code-"), "daygrain_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("daygrain", os.path.relpath(full, root)))
    return path


# rows and bytes that go to a Python worker at once, at most
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Have Spark send this package's code to the executors' Python workers (code only, no data).

    Also bounds the session's Arrow batches, so that long texts do not fill a worker's memory.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) * 1024 ** "bkmgt".find(unit or "b") <= most:
            spark.conf.set(key, str(most))
    path = _archive()
    if not any(str(f).endswith("/daygrain_code.zip") for f in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: one row ``(node, root)`` per node, root the least node.

    Alternates two star operations. In the first each node links its larger neighbours to the least node it
    knows, in the second its smaller ones; both keep the components and shorten every path, until only
    stars remain. Each round is a grouped minimum (combined before the shuffle) and a join, stored in the
    shared folder. No neighbourhood is gathered, so a node with very many links loads no single task.
    An empty input gives an empty result; self links and repeated links change nothing.
    """
    links = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
        .distinct()
    )
    state = None
    while True:
        both = links.unionByName(links.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        # larger neighbours go to the least node known
        least = stored(both.groupBy("child").agg(F.least(F.col("child"), F.min("parent")).alias("least")))
        larger = stored(
            both.where("parent > child")
            .join(least, "child")
            .select(F.col("parent").alias("child"), F.col("least").alias("parent"))
            .distinct()
        )
        # the node itself and its smaller neighbours go to the least of these
        least = stored(larger.groupBy("child").agg(F.min("parent").alias("least")))
        smaller = larger.join(least, "child").where("parent <> least").select(F.col("parent").alias("child"), "least")
        links = stored(
            smaller.unionByName(least.select("child", "least")).distinct().withColumnRenamed("least", "parent")
        )
        now = links.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)")).alias("check"),
        ).first()
        if now == state:
            break
        state = now
    return links.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(
        links.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    )
