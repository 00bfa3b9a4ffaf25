"""Helpers shared by the training-data operators."""
from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither a space nor one of tab .. carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Below so many rows of numbers or short keys a table is broadcast; above, the join shuffles.
SMALL_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only in local mode, where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(spark.sparkContext, "_lodestone_dir", None):
        spark.sparkContext._lodestone_dir = tempfile.mkdtemp(prefix="lodestone-")
    return f"file://{spark.sparkContext._lodestone_dir}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def unstash(*dfs: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for df in dfs:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(df._stashed_at)
        at.getFileSystem(conf).delete(at, True)
    release(dfs[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps now: it does so when their plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = SMALL_ROWS) -> DataFrame:
    """Joins, with a broadcast only if small was counted and is within the bound. small must be cheap to count (stashed)."""
    return df.join(F.broadcast(small) if small.limit(rows + 1).count() <= rows else small, on, how)


def join_salted(df: DataFrame, other: DataFrame, on: list[str], spread: Column, how: str = "inner", rows: int = SMALL_ROWS, salts: int = 16) -> DataFrame:
    """join_small for keys of which a few may hold a large part of df's rows.

    Where other is too large to broadcast, its rows are repeated for each of so many salts, and df's rows are dealt to salts by spread.
    """
    if other.limit(rows + 1).count() <= rows:
        return df.join(F.broadcast(other), on, how)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def join_counted(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner", count: str = "c", parts: int = 2000) -> DataFrame:
    """Join (inner or left) of df with one row a key of other, where count says how many rows of df have the key.

    Keys that hold over one in parts of all rows are fewer than parts: these are broadcast; the others shuffle, as no task gets
    many. It behaves alike at every size.
    """
    total = other.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = other.where(F.col(count) * parts > total)
    cold = other.where(F.col(count) * parts <= total)
    return df.join(F.broadcast(hot), on).unionByName(df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))


def join_spread(df: DataFrame, other: DataFrame, on: str, spread: Column, keys: DataFrame, parts: int = 500) -> DataFrame:
    """Inner join of df with one wide row a key of other. keys: a written table that has df's keys as often as df.

    Keys that hold over one in parts of df's rows are fewer than parts. Their numbers of salts are broadcast, not their rows:
    df's rows are dealt to these salts by spread, and other's row is repeated for each.
    """
    counts, total = keys.groupBy(on).agg(F.count("*").alias("_c")), keys.count()
    salts = F.broadcast(counts.where(F.col("_c") * parts > total).select(on, F.ceil(F.col("_c") * parts / max(1, total)).cast("int").alias("_salts")))
    n = F.coalesce("_salts", F.lit(1))
    left = df.join(salts, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), n).cast("int")).drop("_salts")
    right = other.join(salts, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return left.join(right, [on, "_salt"]).drop("_salt")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash32(*parts: Column) -> Column:
    """First 32 bits of md5 over parts, the same in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def crc(c: Column) -> Column:
    return F.crc32(c.cast("string"))
