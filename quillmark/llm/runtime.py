"""What the operators share: materialised cuts in the cluster's shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the size and quality contracts: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of at most so many rows, all of fixed-width or short columns, may be broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of text for which a hash shard answers, and how much larger texts are than their compressed files, about.
SHARD_TEXT, UNPACKED = 16 << 20, 3

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. A local session without the setting gets a temporary one; a cluster must have it."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillmark-"))
    return shared_dir(spark)


def folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed when this Python process ends."""
    path = f"{shared_dir(spark)}/quillmark-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended: the shared folder's own retention applies
            return


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet below the shared folder and read from there: lineage ends, lost executors cost a re-read."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """small, marked for broadcast only after its rows were counted; beyond the bound Spark joins by shuffle, with AQE's skew handling."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def null_key(column: str):
    """A non-null text key for a nullable column: null and the empty string stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shards_for(docs: DataFrame, most: int = 1 << 22) -> int:
    """Hash shards for the words, n-grams or strings of docs, a file scan: one for every SHARD_TEXT bytes of text, as the sizes of its files tell, at least the shuffle partitions."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    on_disk = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(max(shards(docs.sparkSession), -(-on_disk * UNPACKED // SHARD_TEXT)), most)
