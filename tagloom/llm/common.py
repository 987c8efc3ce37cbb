"""What the training-data operators share: tables, shared storage, batches, caches."""
from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an operator works on at once; texts may be long.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, rows: int = BATCH_ROWS, most: int = BATCH_BYTES):
    """Arrow batches of at most ``rows`` rows and about ``most`` bytes (a longer row alone).

    The bound holds inside the operator, whatever the session says when it runs.
    """
    for b in batches:
        step = max(1, min(rows, rows if not b.num_rows else int(rows * most // max(most, b.nbytes * rows // b.num_rows))))
        for at in range(0, b.num_rows, step):
            yield b if step >= b.num_rows else b.slice(at, step)
    b = None
    give_back_memory()


def give_back_memory() -> None:
    """Return freed pages to the system; a Python worker lives on after its task, idle or not."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Without it only a local session can go on, in a folder under its warehouse.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/tagloom-shared"
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tagloom_path = path
    return out


def drop_stored(*frames: DataFrame | None) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tagloom_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_names(taken: Iterable[str], wanted: Iterable[str]) -> dict[str, str]:
    """wanted -> a name that no column of ``taken`` has: underscores are put before it."""
    used, out = {c.lower() for c in taken}, {}
    for name in wanted:
        new = name
        while new.lower() in used:
            new = f"_{new}"
        used.add(new.lower())
        out[name] = new
    return out


def process_cache(key, make):
    """One value per Python process, also across tasks in a reused worker."""
    cache = sys.__dict__.setdefault("_tagloom_cache", {})
    if key not in cache:
        if len(cache) > 64:
            cache.clear()
        cache[key] = make()
    return cache[key]


def held_out_column(doc_id="doc_id"):
    """Whether a row is for testing only: crc32 of the id as text, mod 4, is 2."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4) == 2


def is_training(doc_id="doc_id"):
    """Rows that a model may learn from; a null id is never one of them."""
    return F.coalesce(~held_out_column(doc_id), F.lit(False))
