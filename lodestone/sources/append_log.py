"""A log of rows to which each batch is appended once, by any number of writers.

A batch's rows are written to a folder of their own, which counts only once a commit names it. Commits are numbered files that are
put in place whole, and only where no file of that number is: of two writers one gets the number, and the other looks again at what
is there. A batch whose id is committed is not appended again; what a writer leaves behind that dies before its commit is never read.
"""
from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from .tables import cut_lineage, new_alerts


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file in place at once, if there is none; whether it did."""
    fs, to = _files(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(to.getParent())
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":  # a rename would replace a local file, a link does not
            os.link(part.toUri().getPath(), to.toUri().getPath())
            return True
        return not fs.exists(to) and bool(fs.rename(part, to))
    except FileExistsError:
        return False
    finally:
        fs.delete(part, False)


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The log's commits in order: batch and folder."""
    fs, at = _files(spark, f"{path}/_commits")
    if not fs.exists(at):
        return []
    files = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")), key=lambda p: p.getName())
    out = []
    for p in files:
        stream = fs.open(p)
        out.append(json.loads(bytes(stream.readAllBytes()).decode()))
        stream.close()
    return out


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of committed batches."""
    folders = [f"{path}/{c['folder']}" for c in commits(spark, path)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append_batch(df: DataFrame, path: str, batch: str, key: str | None = None) -> bool:
    """Appends df to the log as a batch, unless a batch of that id is there; whether it did.

    key: only rows whose key no committed batch holds are appended, each key once. A writer that another one has overtaken compares its rows
    with what has come meanwhile before it tries again.
    """
    spark = df.sparkSession
    rows = cut_lineage(df.dropDuplicates([key]) if key else df)
    folder, seen = None, 0
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    while True:
        there = commits(spark, path)
        if any(c["batch"] == batch for c in there):
            done = False
            break
        if folder is None or (key and len(there) > seen):
            if folder:
                _remove(spark, f"{path}/{folder}")
            folder, seen = f"data/{uuid.uuid4().hex}", len(there)
            old = spark.read.schema(ddl).parquet(*[f"{path}/{c['folder']}" for c in there]) if there else None
            (new_alerts(rows, old, key) if key and old is not None else rows).write.parquet(f"{path}/{folder}")
        done = put_new(spark, f"{path}/_commits/{len(there):012}.json", json.dumps({"batch": batch, "folder": folder}))
        if done:
            break
    if not done and folder:
        _remove(spark, f"{path}/{folder}")
    return done


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def append_stream(stream: DataFrame, path: str, checkpoint: str, name: str, key: str | None = None) -> None:
    """Appends a stream's batches to the log; a batch that runs again after a failure is not appended twice."""
    def append(batch: DataFrame, n: int) -> None:
        append_batch(batch, path, f"{name}-{n}", key)

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
