"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

SETTING = "spark.checkpoint.dir"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below spark.checkpoint.dir and reread: computed once, whoever is lost.

    Where the setting is absent, local mode takes a temporary folder and a cluster is refused."""
    spark = df.sparkSession
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.conf.get("spark.master", "local[*]").startswith("local["):
            raise ValueError(f"{SETTING} has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-shared-")
        spark.conf.set(SETTING, base)
    path = f"{base.rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
