"""Helpers shared by the training-data operators: shared storage and input hygiene."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: the whitespace of the word and normalisation rules, as a regex class body.
SPACE = r"\x20\x09-\x0D"

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Where that is unset, a local master (tests)
    uses a temporary folder of this process, removed at exit; on a cluster, where executors
    could not read such a folder, it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|\Z)", master):
        raise ValueError(f"spark.checkpoint.dir is not set, and executors of {master} share no local folder")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="threadloom-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return _LOCAL["dir"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor costs no more than the tasks since the last
    staged table, and values such as row numbers stay what they were when written.
    The files are removed when the session's file system closes.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's file system closes."""
    path = f"{shared_dir(spark)}/threadloom/{uuid.uuid4().hex}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Just the columns an operator reads, under fixed names; null text counts as empty.

    Whatever other columns the input has cannot clash with an operator's own.
    """
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c).alias(c) for c in more],
    )


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, as the number of ranges to sort into."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def give_back(spark: SparkSession | None = None) -> None:
    """Return what the driver's Python has freed to the system, for the JVM next to it.

    With ``spark`` the JVM collects too, which also removes the shuffle files of frames that are gone.
    """
    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


Batches = Iterable[pa.RecordBatch]
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def map_arrow(df: DataFrame, run: Callable[[Batches], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size, and workers that give memory back.

    Texts are long, so Spark's ten thousand rows in a batch are too many: the session's
    limits are lowered to a thousand rows and some megabytes. A Python worker stays alive
    after its task; what the task took is returned to the system, for the JVM next to it.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key, str(most))
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))

    def lean(batches: Batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(lean, schema)
