"""Tables that are read several times are written once, to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from files below ``spark.checkpoint.dir``; where that is unset, Spark must run on one machine
    and a temporary folder does."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="docloom-"))
    path = f"{folder.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
