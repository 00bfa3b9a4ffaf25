"""Shares, deltas, change points, diffs and stratified picks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_within(df: DataFrame, value: str, keys: list[str], name: str = "share") -> DataFrame:
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*keys)))


def bin_delta(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.withColumn("delta_from_previous", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """df sorted by keys and then order, with each row's place within its keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).orderBy(*keys, name)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def top_k_other(df: DataFrame, keys: list[str], category: str, value: str, k: int) -> DataFrame:
    """Categories beyond the k largest become 'other'; values are summed again and shared within keys."""
    top = df.groupBy(category).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), category).limit(k).select(category, F.lit(True).alias("_top"))
    out = df.join(F.broadcast(top), category, "left").withColumn(category, F.when(F.col("_top"), F.col(category)).otherwise("other"))
    return share_within(out.groupBy(*keys, category).agg(F.sum(value).alias(value)), value, keys)


def change_points(df: DataFrame, key: str, order: str, value: str, window: int = 5, n: int = 3) -> DataFrame:
    """Shift of mean and variance between the window rows before and from each place; local peaks first, then the strongest."""
    w = Window.partitionBy(key).orderBy(order)
    left, right, whole = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1), Window.partitionBy(key)
    v = F.col(value)
    rows = df.withColumns({"left_mean": F.avg(v).over(left), "right_mean": F.avg(v).over(right), "_lv": F.var_pop(v).over(left), "_rv": F.var_pop(v).over(right), "_sd": F.stddev_pop(v).over(whole), "_i": F.row_number().over(w), "_n": F.count("*").over(whole)})
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    score = F.abs(F.col("right_mean") - F.col("left_mean")) / sd + F.abs(F.col("_rv") - F.col("_lv")) / (sd * sd)
    rows = rows.where((F.col("_i") > window) & (F.col("_i") <= F.col("_n") - window)).withColumn("change_score", score)
    rows = rows.withColumn("is_peak", F.coalesce((F.col("change_score") >= F.lag("change_score").over(w)) & (F.col("change_score") >= F.lead("change_score").over(w)), F.lit(False)))
    best = Window.partitionBy(key).orderBy(F.desc("is_peak"), F.desc("change_score"), order)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select(key, order, "change_score", "left_mean", "right_mean", "is_peak", "rank")


def longitudinal_diff(df: DataFrame, key: str, order: list[str], text: str, counts: dict[str, Column]) -> DataFrame:
    """Each capture against the entity's one before: whether its text changed, and by how much each count did."""
    w = Window.partitionBy(key).orderBy(*order)
    h = F.sha1(F.coalesce(F.col(text), F.lit("")))
    rows = df.withColumns({"_h": h, **{f"_{n}": c for n, c in counts.items()}})
    rows = rows.withColumns({"_ph": F.lag("_h").over(w), "previous": F.lag(order[0]).over(w), **{f"delta_{n}": F.col(f"_{n}") - F.lag(f"_{n}").over(w) for n in counts}})
    return rows.where("_ph is not null").select(key, *order, "previous", (F.col("_h") != F.col("_ph")).alias("text_changed"), *[f"delta_{n}" for n in counts])


def stratified_round_robin(df: DataFrame, strata: list[str], order: list, n: int) -> DataFrame:
    """First of each stratum, then the second of each, up to n rows."""
    rows = df.withColumn("round", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    return rows.orderBy("round", *strata).limit(n)


def examples(df: DataFrame, keys: list[str], id_col: str, k: int) -> DataFrame:
    """Up to k smallest ids of each group."""
    rows = top_per_group(df, keys, [F.col(id_col)], k)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(id_col)).alias("examples"))


def temporal_coverage(df: DataFrame, lo: int, hi: int, k: int) -> DataFrame:
    """Each year of the range with its rows and those of its bin."""
    spark = df.sparkSession
    years = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("year"))
    out = years.join(df.groupBy("year").agg(F.count("*").alias("rows")), "year", "left").fillna(0, ["rows"])
    out = out.withColumn("bin", (F.floor(F.col("year") / k) * k).cast("int"))
    return out.withColumn("bin_rows", F.sum("rows").over(Window.partitionBy("bin"))).withColumn("covered", F.col("rows") > 0)


def early_links(df: DataFrame, key: str, home: str, until: int, over: float = 0.05) -> DataFrame:
    """First bin up to a year in which a key other than home has an index above over."""
    hit = df.where((F.col(key) != home) & (F.col("bin") <= until) & (F.col("index") > over))
    return hit.groupBy(key).agg(F.min("bin").alias("first_bin"), F.min_by("index", "bin").alias("first_index"), F.min_by("rows", "bin").alias("rows"))


def velocity(snapshots: DataFrame, at: str = "snapshot_at", rows: str = "rows") -> DataFrame:
    """snapshots: one row each, with its time and number of rows. Adds gain, days and daily gain since the snapshot before."""
    w = Window.orderBy(at)  # one row for each snapshot
    days = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 86_400_000_000
    out = snapshots.withColumns({"gain": F.col(rows) - F.lag(rows).over(w), "days": days})
    return out.withColumn("daily_gain", F.when(F.col("days") > 0, F.col("gain") / F.col("days")))


def stall(snapshots: DataFrame, at: str = "snapshot_at", rows: str = "rows", recent: int = 6, least_gain: float = 5.0, stale_days: float = 3.0) -> DataFrame:
    """One row for the last recent snapshots: daily gain on average and last, and whether capture has stalled.

    It has if the last daily gain is under least_gain after at least stale_days, or if three gains or more average under 1 a day.
    """
    last = velocity(snapshots.orderBy(F.desc(at)).limit(recent), at, rows)
    newest = F.struct(F.col(at))
    one = last.agg(F.count("*").alias("snapshots"), F.max_by(rows, newest).alias("current_rows"), F.coalesce(F.avg("daily_gain"), F.lit(0.0)).alias("avg_daily_gain"), F.count("daily_gain").alias("gains"), F.coalesce(F.max_by("daily_gain", F.when(F.col("daily_gain").isNotNull(), newest)), F.lit(0.0)).alias("recent_daily_gain"), F.coalesce(F.max_by("days", newest), F.lit(0.0)).alias("days_since_previous"))
    few = F.col("snapshots") < 2
    stalled = ((F.col("recent_daily_gain") < least_gain) & (F.col("days_since_previous") >= stale_days)) | ((F.col("gains") >= 3) & (F.col("avg_daily_gain") < 1.0))
    return one.withColumns({"insufficient_history": few, "stall_detected": ~few & stalled})
