"""Tables between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on this one machine (local mode) gets a folder of its own; a cluster has to name one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends here, and a lost executor costs no recomputation of what came before."""
    place = f"{shared_dir(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
