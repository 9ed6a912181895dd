"""Tables that iterative operators write once: lineage is cut in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a stored table that one task is dealt. Adaptive execution counts compressed bytes: of rows that compress well it gives
#: one task millions, and each sort and aggregate of that task holds them uncompressed.
TASK_ROWS = 300_000


def dealt(df: DataFrame, table: DataFrame, *keys) -> DataFrame:
    """df by keys in as many tasks as the rows of the stored table fill; no more than the session's cores are left to the session."""
    n, spark = -(-table.count() // TASK_ROWS), df.sparkSession
    return df.repartition(n, *keys) if n > min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) else df


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
