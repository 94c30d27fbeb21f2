"""Shared pieces: the shared scratch folder, table reading and cut lineage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python; long texts make larger batches costly.
ARROW_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    It is set to a temporary folder only in local mode, where the session leaves it unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/evidentia/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(remove)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder, in a folder for each value of `by` if given, and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_scratch(*frames: DataFrame) -> None:
    """Delete tables that materialise wrote and no later step reads. The driver's garbage is collected
    too, since Spark deletes the shuffle files of past steps only once their plans are garbage."""
    for df in frames:
        _remove(df.sparkSession, df._scratch)
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small; never raise what the session has set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sent:
    """A broadcast object, pickled with its code and unpickled once in each task."""

    def __init__(self, spark: SparkSession, value: object):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._own: list = []

    def __getstate__(self) -> dict:
        return {"_sent": self._sent, "_own": []}

    @property
    def value(self):
        if not self._own:
            self._own.append(cloudpickle.loads(self._sent.value))
        return self._own[0]

    def close(self) -> None:
        """Free it on driver and executors; no job may read it again."""
        self._sent.destroy()


def named(docs: DataFrame) -> DataFrame:
    """doc_id (long), text, unnamed: rows without doc_id are numbered down from the greatest long, and written, so
    that they keep their number when a task runs again; unnamed tells them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blank = rows.where("doc_id IS NULL")
    out = rows.where("doc_id IS NOT NULL").withColumn("unnamed", F.lit(False))
    if blank.isEmpty():
        return out
    own = F.lit(2**63 - 1) - F.monotonically_increasing_id()
    return out.unionByName(materialise(blank.select(own.alias("doc_id"), "text", F.lit(True).alias("unnamed")), "unnamed"))
