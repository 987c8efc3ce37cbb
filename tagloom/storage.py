"""Tables that an operator writes once and reads several times, in the folder that all executors share."""
from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it uses its warehouse."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/tagloom-shared"
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: it is computed once, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffles_freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what was ``stored``: it does so once the driver has collected its garbage,
    which else may be after the next large shuffle."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back_memory() -> None:
    """Return freed pages to the system; a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
