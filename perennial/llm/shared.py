"""What the operators of this subpackage share: reading a table, columns by name, the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by Spark's reader, so that any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the batches that go to Python workers, where a session leaves Spark's 64 MB: rows here may be sets or whole
#: texts, and both the executor and the worker hold a few batches at a time, outside what Spark accounts for.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(docs: DataFrame) -> DataFrame:
    """The same rows, in a session whose batches for Python are small unless it has chosen their size itself."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH, None) in ("64MB", f"{64 << 20}b"):
        conf.set(_BATCH, str(BATCH_BYTES))
    return docs


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Just the key and the text, under fixed names, so that other columns' names cannot clash."""
    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def sample_bound(n: int, sample: int) -> int:
    """Below this lie the signed 64-bit hashes of about `sample` of n rows; never of none, however large n is."""
    return max(1 - (1 << 63), min((1 << 63) - 1, (int(sample) << 64) // max(n, 1) - (1 << 63)))


def sampled(rows: DataFrame, n: int, sample: int, seed: int, *columns: str) -> DataFrame:
    """About `sample` of the n rows, by a hash of the columns: the same in every run. Take the text among them, so that
    rows without an id, or with one id, neither all come nor all stay away; of rows equal in them one comes."""
    if n > sample:
        rows = rows.where(F.xxhash64(*columns, F.lit(seed)) < F.lit(sample_bound(n, sample))).dropDuplicates(list(columns))
    return rows


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. Only a session in one process (tests) may do without that
    setting and gets a folder of its own; on a cluster that would be a folder that executors do not share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: computed once, read by all later steps, and there whatever
    executor is lost. Row order and partitions stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: as cut(), smaller, for rows whose order does not matter."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(n_bytes: int, each: int, least: int = 8) -> int:
    """So many partitions that each holds about `each` bytes."""
    return max(least, -(-n_bytes // each))

