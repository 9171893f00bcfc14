"""Where streams, and tables that are read more than once, are kept."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the one all executors share; only on one machine, as in tests, a temporary one where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="quern-stream-")
    # A path without a scheme is of the cluster's default file system, for Spark and for workers alike.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return f"{whole.rstrip('/')}/quern-stream-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a written table of the shared folder, for what is read more than once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
