"""The request log: batch and streaming month usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import METERING



def read(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Records of JSON lines; lines that are none are left out."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(METERING).option("mode", "DROPMALFORMED").json(path)


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def usage(records: DataFrame) -> DataFrame:
    """(key_id, month, queries, indexes, bytes): index operations counted apart. Works on a stream as well."""
    is_index = (F.col("method") == "POST") & (F.col("path") == "/v1/index")
    return records.groupBy("key_id", F.substring("ts", 1, 7).alias("month")).agg(
        F.sum(F.when(is_index, 0).otherwise(1)).alias("queries"), F.sum(F.when(is_index, 1).otherwise(0)).alias("indexes"), F.sum("response_bytes").alias("bytes")
    )


def reaches(records: DataFrame, key: str, month: str, quota: int) -> bool:
    """Whether a key has used up its queries of a month; reads no further than needed."""
    is_index = (F.col("method") == "POST") & (F.col("path") == "/v1/index")
    return records.where((F.col("key_id") == key) & F.col("ts").startswith(month) & ~is_index).limit(quota).count() >= quota


def active(indexes: DataFrame, now: int) -> DataFrame:
    """(key_id, active): indexes that have not expired."""
    return indexes.groupBy("key_id").agg(F.count_if(F.col("expires_at").isNull() | (F.col("expires_at") > now)).alias("active"))
