"""Reading, uniting and writing tables."""
from __future__ import annotations

import csv
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only in local mode, where it is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark, "_lodestone_folder", None) or f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark._lodestone_folder = at
    return at


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what is read more than once is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._lodestone_steps = [*getattr(spark, "_lodestone_steps", []), path]
    return spark.read.schema(df.schema).parquet(path)


def drop_steps(spark: SparkSession) -> None:
    """Deletes what cut_lineage has written so far. For when results are written: DataFrames made of these steps cannot be read any more."""
    for path in getattr(spark, "_lodestone_steps", []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark._lodestone_steps = []


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, extra: str | None = None) -> DataFrame:
    """CSV with a header, all strings; a byte-order mark is dropped. extra: the column that gets the cells beyond the header."""
    reader = spark.read.option("multiLine", True).option("escape", '"').option("header", True).option("inferSchema", False)
    if extra:
        return read_ragged(spark, path, [c.lstrip("\ufeff") for c in reader.csv(path).columns], extra, header=True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def split_cells(n: int):
    """Column function: the first n cells of a CSV line (null if empty or absent), and the other cells joined by commas (null if there are none)."""
    kind = pa.struct([("cells", pa.list_(pa.string())), ("extra", pa.string())])

    @F.arrow_udf("struct<cells:array<string>,extra:string>")
    def split(line: pa.Array) -> pa.Array:
        csv.field_size_limit(1 << 31)
        out = []
        for x in line.to_pylist():
            cells = next(csv.reader([x]), []) if x else []
            out.append({"cells": [c or None for c in cells[:n]] + [None] * (n - len(cells)), "extra": ",".join(cells[n:]) if len(cells) > n else None})
        return pa.array(out, kind)

    return split


def read_ragged(spark: SparkSession, path: str, names: list[str], extra: str, header: bool = False) -> DataFrame:
    """CSV lines of strings, of which some have more cells than there are names: these are joined by commas in extra.

    header: lines that repeat the names are left out. Blank lines are none. Only lines with as many commas as names, or more, can
    have surplus cells: they are split one by one, however many cells they have; the others are read by Spark.
    """
    n, given = len(names), F.regexp_replace("value", "^\ufeff|\r$", "")
    lines = spark.read.text(path).select(given.alias("value")).where("value <> ''")
    wide = F.regexp_count("value", F.lit(",")) >= n
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(n)), {"escape": '"'})
    plain = lines.where(~wide).select(cells.alias("c")).select(*[F.col(f"c.c{i}").alias(f"c{i}") for i in range(n)], F.lit(None).cast("string").alias("extra"))
    ragged = lines.where(wide).select(split_cells(n)(F.col("value")).alias("c")).select(*[F.col("c.cells")[i].alias(f"c{i}") for i in range(n)], F.col("c.extra").alias("extra"))
    rows = plain.unionByName(ragged)
    if header:
        rows = rows.where(~reduce(lambda a, b: a & b, [F.col(f"c{i}").eqNullSafe(F.lit(x)) for i, x in enumerate(names)]))
    return rows.toDF(*names, extra)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; blank and broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def flatten_payload(df: DataFrame, rows: str, cols: list[str]) -> DataFrame:
    """A row for each element of an array of structs, with its fields joined as one text."""
    out = df.withColumn("_r", F.explode(rows))
    return out.withColumn("text_blob", F.concat_ws(" ", *[F.col(f"_r.{c}").cast("string") for c in cols])).drop("_r", rows)


def union_tables(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)


def append_log(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").option("header", True).format(fmt).save(path)


def new_alerts(new: DataFrame, existing: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts whose id is not there yet, each once."""
    return new.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def append_alerts(new: DataFrame, path: str, key: str = "alert_id") -> None:
    """Appends the alerts that the table at path does not hold yet; running it again appends nothing."""
    spark = new.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    (new_alerts(new, spark.read.parquet(path), key) if there else new.dropDuplicates([key])).write.mode("append").parquet(path)


def to_metrics(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A summary as rows of (keys, metric, value)."""
    cols = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keys), cols, "metric", "value")


def freeze(df: DataFrame, dims: list[str], index) -> dict[str, DataFrame]:
    """The facts, an index table for each dimension, and a manifest of counts."""
    out = {"facts": df, **{f"index_by_{d}": index(df, [d]) for d in dims}}
    parts = [df.groupBy(F.col(d).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(d).alias("dimension"), "key", "n") for d in dims]
    out["manifest"] = reduce(DataFrame.unionByName, parts)
    return out


def load_lexicon(spark: SparkSession, path: str, target: str, context: str, domains: str = "domains", merge_domains: bool = True) -> DataFrame:
    """Long table (group, term) of a lexicon in JSON; with merge_domains, domain terms count as context terms too."""
    raw = spark.read.option("multiLine", True).json(path)
    names = raw.select(f"{domains}.*").columns
    part = lambda group, col: raw.select(F.lit(group).alias("group"), F.explode(col).alias("term"))
    parts = [part("target", target), part("context", context), *[part(n, f"{domains}.{n}") for n in names]]
    if merge_domains:
        parts += [part("context", f"{domains}.{n}") for n in names]
    return reduce(DataFrame.unionByName, parts).distinct()


def terms_of(lexicon: DataFrame, group: str) -> list[str]:
    """A group's terms, sorted; a lexicon is configuration, small enough to be part of the plan."""
    return [r.term for r in lexicon.where(F.col("group") == group).select("term").distinct().orderBy("term").collect()]


def snapshot_date(df: DataFrame) -> DataFrame:
    """Adds snapshot_date: the last eight digits in a file's path (its own name, or its table's) that are a date, else the day it was changed."""
    dates = F.transform(F.regexp_extract_all("_metadata.file_path", F.lit(r"(?<![0-9A-Za-z])\d{8}(?![0-9A-Za-z])"), F.lit(0)), lambda x: F.try_to_date(x, "yyyyMMdd"))
    named = F.try_element_at(F.array_compact(dates), F.lit(-1))
    return df.select("*", F.coalesce(named, F.to_date("_metadata.file_modification_time")).alias("snapshot_date"))


ALIASES = {"brand": ["brand_or_category", "brand"], "target_marker": ["target_marker", "target_markers", "matched_target_markers"], "context_marker": ["context_marker", "context_markers", "matched_context_markers"], "source_ref": ["source_url", "source_url_or_archive_ref", "source_ref", "source_id", "source_name"]}


def conform(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Canonical columns from the first alias that is there and not blank."""
    out = {}
    for name, options in aliases.items():
        there = [F.nullif(F.trim(F.col(o).cast("string")), F.lit("")) for o in options if o in df.columns]
        out[name] = F.coalesce(*there) if there else F.lit(None).cast("string")
    return df.withColumns(out)
