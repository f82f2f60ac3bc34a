"""Reading and writing archives: schemas, sentinels, codecs, digests, idempotent appends."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An archive row: a narrative with its kind, place, time, vector and free attributes.
ARCHIVE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "title", "content", "content_type")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(c, T.StringType()) for c in ("state", "species")]
    + [T.StructField("effective_date", T.DateType()), T.StructField("created_at", T.TimestampType()), T.StructField("signal_weight", T.DoubleType()), T.StructField("metadata", T.StringType())]
)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, from spark.checkpoint.dir. Only a session in one process (tests) may do without that setting
    and gets a folder of its own; on a cluster that would be a folder that executors do not share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def scan(archive: DataFrame, kinds: Sequence[str] | None = None, state: str | None = None, day_from: str | None = None, day_to: str | None = None, kind: str = "content_type", place: str = "state", day: str = "effective_date") -> DataFrame:
    """The rows that all given bounds admit; each bound is a plain comparison, so it reaches partitions and row groups."""
    out = archive
    if kinds is not None:
        out = out.where(F.col(kind).isin(*kinds))
    if state is not None:
        out = out.where(F.col(place) == state)
    if day_from is not None:
        out = out.where(F.col(day) >= F.lit(day_from).cast("date"))
    if day_to is not None:
        out = out.where(F.col(day) <= F.lit(day_to).cast("date"))
    return out


def missing_to_null(df: DataFrame, sentinels: Mapping[str, Sequence[float]]) -> DataFrame:
    """Sentinel values of each column as nulls, at the scan."""
    return df.withColumns({c: F.when(~F.col(c).isin(*values), F.col(c)) for c, values in sentinels.items()})


def fixed_width(spark: SparkSession, path: str, columns: Sequence[tuple[str, int, int, str]]) -> DataFrame:
    """Text lines cut into (name, start from 1, length, type); blanks are null."""
    cut = lambda s, n: F.nullif(F.trim(F.substring("value", s, n)), F.lit(""))
    return spark.read.text(path).select(*(cut(s, n).try_cast(kind).alias(name) for name, s, n, kind in columns))


def append_new(target: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of a batch whose key the target lacks, each key once: what an insert that ignores duplicates appends."""
    return batch.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")


def upsert(target: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """The target with the batch's rows in place of those with equal keys."""
    return target.join(batch.select(*key), list(key), "left_anti").unionByName(batch)


def row_digest(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """rows and an order-independent digest of them: equal for a faithful copy, different for any changed value."""
    h = F.xxhash64(row_digest(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).alias("digest"))


_SERIES = "scale int, days int, first date, blob binary"
_SENTINEL = -32768


def encode_series(df: DataFrame, key: Sequence[str], day: str, value: str) -> DataFrame:
    """A series a key as big-endian int16 a day: the least scale of 1, 10, 100, 1000 that keeps its decimals; days
    without a value are the sentinel. Values that no scale keeps, or out of range at that scale, are an error. A series is
    one key's days."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[value]).sort_values(day)
        v = rows[value].to_numpy(float)
        scale = next((s for s in (1, 10, 100, 1000) if np.allclose(np.round(v * s), v * s, rtol=0, atol=1e-6)), None)
        if scale is None:
            raise ValueError("a value has more than three decimals: the codec would round it")
        at = (pd.to_datetime(rows[day]) - pd.to_datetime(rows[day].iloc[0])).dt.days.to_numpy() if len(rows) else np.zeros(0, int)
        scaled = np.round(v * scale)
        if len(v) and np.abs(scaled).max() > 32767:
            raise ValueError("a value is out of the codec's range")
        cells = np.full(int(at[-1]) + 1 if len(at) else 0, _SENTINEL, ">i2")
        cells[at] = scaled
        out = rows[list(key)].head(1).copy()
        out["scale"], out["days"], out["first"], out["blob"] = scale, len(cells), rows[day].iloc[0] if len(rows) else None, cells.tobytes()
        return out

    schema = ", ".join(f"{c} {k}" for c, k in df.dtypes if c in key) + ", " + _SERIES
    return df.where(F.col(value).isNotNull()).select(*key, day, value).groupBy(*key).applyInPandas(pack, schema)


def decode_series(df: DataFrame, key: Sequence[str], day: str = "day", value: str = "value") -> DataFrame:
    """The long form of encode_series(), without the days that have no value: built-in functions only."""
    number = lambda i: F.conv(F.hex(F.substring(F.col("blob"), i * 2 + 1, F.lit(2))), 16, 10).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("days") - 1), lambda i: F.struct(F.date_add("first", i).alias("d"), F.when(number(i) >= 32768, number(i) - 65536).otherwise(number(i)).alias("v")))
    out = df.where("days > 0").select(*key, "scale", F.explode(cells).alias("c")).where(F.col("c.v") != _SENTINEL)
    return out.select(*key, F.col("c.d").alias(day), (F.col("c.v") / F.col("scale")).alias(value))


def export_ndjson(df: DataFrame, path: str) -> DataFrame:
    """Writes gzip'd lines of JSON and compares the copy with the source: rows and digests of both."""
    df.write.mode("error").json(path, compression="gzip", ignoreNullFields=False)
    copy = df.sparkSession.read.schema(df.schema).json(path)
    both = table_digest(df).withColumn("side", F.lit("source")).unionByName(table_digest(copy).withColumn("side", F.lit("copy")))
    return both.groupBy().agg(F.countDistinct("rows", "digest").alias("kinds"), F.max("rows").alias("rows")).select((F.col("kinds") == 1).alias("faithful"), "rows")
