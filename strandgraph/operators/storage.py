"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and all runs on one machine."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = tempfile.mkdtemp(prefix="strandgraph-")
        spark.sparkContext.setCheckpointDir(got)
    return got


#: Folders that this driver has written.
_OWN: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, which cuts its lineage and outlives executors."""
    own = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{own}"
    _OWN.add(own)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again; whatever else they are made of stays."""
    for df in tables:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1] in _OWN:
                context = df.sparkSession.sparkContext
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
