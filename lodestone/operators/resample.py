"""Seeded samples, trends, bootstrap and permutation tests. Draws are hashes, so that any engine repeats them."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_rank
from ..sources.tables import cut_lineage


def sample_per_stratum(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int) -> DataFrame:
    w = Window.partitionBy(*keys)
    h = hash_rank(seed, F.col(id_col).cast("string"))
    rows = df.withColumn("available", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy(h, id_col)))
    return rows.where(F.col("_n") <= n).drop("_n")


def balance_bins(df: DataFrame, bin_col: str, positive: str, id_col: str, ratio: float, seed: int) -> DataFrame:
    """All positives of a bin, and negatives in hashed order up to ratio times as many."""
    w = Window.partitionBy(bin_col)
    pos = F.count_if(F.col(positive)).over(w)
    rank = F.row_number().over(Window.partitionBy(bin_col, positive).orderBy(hash_rank(seed, F.col(id_col).cast("string")), id_col))
    return df.withColumns({"_p": pos, "_r": rank}).where(F.col(positive) | (F.col("_r") <= F.round(F.col("_p") * ratio))).drop("_p", "_r")


def balanced_index(all_rows: DataFrame, balanced: DataFrame, bin_col: str, positive: str, value: str, weight: str, k: int) -> DataFrame:
    """all_rows, and what balance_bins left of them. For each bin of k years: rows, the weighted index of the balanced rows, whether it can be used."""
    here = all_rows.groupBy(bin_col).agg(F.count_if(~F.col(positive)).alias("negatives_available"))
    out = balanced.groupBy(bin_col).agg(F.count_if(positive).alias("positives"), F.count_if(~F.col(positive)).alias("negatives_sampled"), F.count("*").alias("sampled_rows"), F.sum(weight).alias("weight_sum"), F.sum(F.col(value) * F.col(weight)).alias("_v"))
    out = here.join(out, bin_col, "left").fillna(0)
    index = F.when(F.col("weight_sum") > 0, F.col("_v") / F.col("weight_sum")).otherwise(0.0)
    return out.select(bin_col, (F.col(bin_col) + k / 2).alias("midpoint"), "positives", "negatives_available", "negatives_sampled", "sampled_rows", "weight_sum", index.alias("balanced_index"), ((F.col("positives") > 0) & (F.col("negatives_sampled") > 0)).alias("usable"))


# Priorities of the reasons for an audit, source types to suspect, and when a year is rare and a source overused
AUDIT = {"low_confidence": 90, "verified_but_suspect_source_type": 85, "rare_year": 70, "highly_reused_source_artifact": 65, "single_record_brand": 55, "deterministic_random_sample": 10}
SUSPECT_TYPES = ["personal_blog", "review_platform", "blog", "social_media", "forum"]
RARE_YEAR, REUSED_SOURCE = 2, 20


def audit_rules(df: DataFrame) -> tuple[DataFrame, list[tuple[Column, int, str]]]:
    """df with the counts that the rules ask for, and the rules, in order."""
    for key, name in (("year", "_years"), ("brand", "_brands"), ("source_ref", "_sources")):
        df = df.join(df.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)), key, "left")
    c = F.col
    tests = {
        "low_confidence": c("confidence_score").isNull() | (c("confidence_score") < 0.5), "verified_but_suspect_source_type": (c("verification_level") == "verified") & F.lower("source_type").isin(SUSPECT_TYPES),
        "rare_year": c("_years") <= RARE_YEAR, "single_record_brand": c("_brands") == 1, "highly_reused_source_artifact": c("_sources") >= REUSED_SOURCE,
    }
    return df, [(F.coalesce(t, F.lit(False)), AUDIT[n], n) for n, t in tests.items()]


def audit_queue(df: DataFrame, id_col: str, rules: list[tuple[Column, int, str]], n: int, seed: int) -> DataFrame:
    """Rows by the priority of the rules that they meet, then in hashed order, up to n; rows that meet none fill up."""
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, _, name in rules]))
    fill = "deterministic_random_sample"
    top = F.greatest(F.lit(AUDIT[fill]), *[F.when(test, p).otherwise(0) for test, p, _ in rules])
    rows = df.withColumns({"reasons": F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(fill))), "priority": top})
    return rows.orderBy(F.desc("priority"), hash_rank(seed, F.col(id_col).cast("string")), id_col).limit(n)


def weighted_slope(x: str, y: str, w: str) -> Column:
    """Weighted least-squares slope, as an aggregate; null without variation. x should be centred."""
    a = lambda c: F.sum(F.col(w) * c)
    X, Y = F.col(x), F.col(y)
    var = F.sum(w) * a(X * X) - a(X) * a(X)
    return F.when(var > 1e-9, (F.sum(w) * a(X * Y) - a(X) * a(Y)) / var)


def trend_series(df: DataFrame, keys: list[str], year: str, k: int, value: str, weight: str) -> DataFrame:
    b = (F.floor(F.col(year) / k) * k).cast("int")
    w = F.sum(weight)
    return df.groupBy(*keys, b.alias("bin")).agg(F.when(w > 0, F.sum(F.col(value) * F.col(weight)) / w).alias("index"), w.alias("weight_sum"), F.count("*").alias("rows"))


def _draws(points: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """points: key, i (1 to n), n, ... For each replicate n draws with replacement; i of the drawn point."""
    spark = points.sparkSession
    each = points.select(key, "n", F.col("i").alias("j")).join(F.broadcast(spark.range(reps).select(F.col("id").alias("rep"))), F.lit(True))  # reps numbers
    return each.select(key, "rep", (hash_rank(seed, F.col(key).cast("string"), F.col("rep").cast("string"), F.col("j").cast("string")) % F.col("n") + 1).alias("i"))


def numbered(series: DataFrame, key: str, x: str) -> DataFrame:
    w = Window.partitionBy(key)
    return series.withColumns({"i": F.row_number().over(w.orderBy(x)), "n": F.count("*").over(w), "xc": F.col(x) - F.avg(x).over(w)})


def bootstrap_trend(series: DataFrame, key: str, x: str, y: str, w: str, reps: int, seed: int) -> DataFrame:
    """For each key with at least 3 points: slope, 95 % interval of order statistics, one-sided p, stability, whether a trend shows."""
    points = numbered(series.where(F.col(y).isNotNull() & (F.col(w) > 0)), key, x).where("n >= 3")
    seen = points.groupBy(key).agg(weighted_slope("xc", y, w).alias("slope"), F.first("n").alias("points"))
    slopes = _draws(points, key, reps, seed).join(points.select(key, "i", "xc", y, w), [key, "i"]).groupBy(key, "rep").agg(weighted_slope("xc", y, w).alias("s")).where("s is not null")
    rank = Window.partitionBy(key)
    slopes = slopes.withColumns({"r": F.row_number().over(rank.orderBy("s", "rep")) - 1, "m": F.count("*").over(rank)})
    at = lambda q: F.greatest(F.lit(0), F.least(F.col("m") - 1, F.floor(F.col("m") * q)))
    sums = slopes.join(seen, key).groupBy(key).agg(F.max(F.when(F.col("r") == at(0.025), F.col("s"))).alias("ci_low"), F.max(F.when(F.col("r") == at(0.975), F.col("s"))).alias("ci_high"), F.avg(F.when(F.col("slope") >= 0, F.col("s") < 0).otherwise(F.col("s") > 0).cast("double")).alias("p_value"))
    out = seen.join(sums, key, "left")
    flat = F.abs("slope") < 1e-12
    out = out.select(key, "points", "slope", *[F.when(flat, v).otherwise(F.col(c)).alias(c) for c, v in (("ci_low", 0.0), ("ci_high", 0.0), ("p_value", 1.0))])
    width = F.col("ci_high") - F.col("ci_low")
    return out.withColumn("stability", F.when(width.isNull(), "insufficient").when(width < 0.1, "high").when(width < 0.2, "medium").otherwise("low")).withColumn("trend_emerged", F.coalesce(F.col("p_value") < 0.10, F.lit(False)))


def permutation_p(series: DataFrame, key: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """Share of permutations of y whose slope is at least as large as the one seen. series: a few points for each key."""
    points = numbered(series, key, x).select(key, "i", "n", "xc", y)
    seen = points.groupBy(key).agg(F.regr_slope(y, "xc").alias("slope"))
    spark = series.sparkSession
    each = points.join(F.broadcast(spark.range(reps).select(F.col("id").alias("rep"))), F.lit(True))
    h = hash_rank(seed, F.col(key).cast("string"), F.col("rep").cast("string"), F.col("i").cast("string"))
    mixed = each.withColumn("k", F.row_number().over(Window.partitionBy(key, "rep").orderBy(h, "i"))).select(key, "rep", F.col("k").alias("i"), F.col(y).alias("py"))
    slopes = mixed.join(points.select(key, "i", "xc"), [key, "i"]).groupBy(key, "rep").agg(F.regr_slope("py", "xc").alias("s"))
    p = slopes.join(seen, key).groupBy(key).agg(F.avg((F.abs("s") >= F.abs("slope") - 1e-12).cast("double")).alias("p_value"))
    return seen.join(p, key)


def sufficiency_curve(rows: DataFrame, order: str, y: str, sizes: list[int], reps: int, seed: int, at: str | None = None) -> DataFrame:
    """Standard error of the slope of y on at (by default order) for samples of each size, drawn with replacement from rows numbered by order."""
    spark = rows.sparkSession
    # all rows get one running number: ranges of order are numbered in parallel, offset by the rows before them; they are
    # written, as a second reading may be cut into other ranges
    flat = cut_lineage(rows.repartitionByRange(order).sortWithinPartitions(order).select("*", F.monotonically_increasing_id().alias("_m")))
    flat = flat.withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = flat.groupBy("_part").agg(F.count("*").alias("c")).withColumn("_before", F.coalesce(F.sum("c").over(before), F.lit(0))).select("_part", "_before")
    points = flat.join(parts, "_part").select((F.col("_before") + F.col("_at") + 1).alias("i"), F.col(at or order).alias("xc"), y)
    n = rows.agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(s,) for s in sizes], "size int").join(spark.range(reps).select(F.col("id").alias("rep")), F.lit(True))
    draws = grid.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("size")))).join(F.broadcast(n), F.lit(True))
    draws = draws.select("size", "rep", (hash_rank(seed, *[F.col(c).cast("string") for c in ("size", "rep", "j")]) % F.col("n") + 1).alias("i"))
    slopes = draws.join(points.select("i", "xc", y), "i").groupBy("size", "rep").agg(F.regr_slope(y, "xc").alias("s"))
    return slopes.groupBy("size").agg(F.stddev_samp("s").alias("slope_se"), F.count("s").alias("replicates"))


def smallest_enough(curve: DataFrame, target: float) -> DataFrame:
    return curve.agg(F.min(F.when(F.col("slope_se") <= target, F.col("size"))).alias("smallest_size"))


def sample_sufficiency(df: DataFrame, keys: list[str], value: str, weight: str, target: float) -> DataFrame:
    """Kish's effective size, mean, half width of the 95 % interval, rows still needed for the target width."""
    w = F.col(weight)
    out = df.groupBy(*keys).agg((F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"), (F.sum(F.col(value) * w) / F.sum(w)).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("effective_n")
    need = F.greatest(F.lit(0), F.ceil((1.96 * F.col("sd") / target) ** 2 - F.col("effective_n")))
    out = out.withColumns({"ci_half_width": half, "additional_needed": F.when(half <= target, 0).otherwise(need).cast("long")})
    return out.withColumn("interpretation", F.when(F.col("additional_needed") == 0, "sufficient").otherwise("insufficient"))


def readiness(df: DataFrame, target: int = 350, near: int = 25, most_tourism: float = 0.40) -> DataFrame:
    """df: rows, p_value, stability, tourism_ratio. records_needed and status: ready, almost_ready or keep_collecting.

    Ready: enough rows and a trend (p under 0.10, high or medium stability) with a balanced mix of sources, or a strong one (p
    under 0.05, high stability) with any mix. Almost: a trend, and at most near rows too few.
    """
    c = F.col
    seen = (c("p_value") < 0.10) & c("stability").isin("high", "medium")
    strong = (c("p_value") < 0.05) & (c("stability") == "high")
    enough = c("rows") >= target
    status = F.when(enough & seen & (c("tourism_ratio") <= most_tourism) | enough & strong, "ready").when((c("rows") >= max(0, target - near)) & seen, "almost_ready").otherwise("keep_collecting")
    return df.withColumns({"records_needed": F.greatest(F.lit(0), target - c("rows")), "status": F.when(c("p_value").isNull(), "keep_collecting").otherwise(status)})


def _poisson(h: Column, most: int = 8) -> Column:
    """A Poisson(1) number from eight hexadecimal digits, compared as strings; at most most (beyond lies under a millionth)."""
    p, total, cuts = math.exp(-1), 0.0, []
    for k in range(most):
        total += p / math.factorial(k)
        cuts.append(f"{int(total * 2**32):08x}")
    out = F.lit(most)
    for k in reversed(range(most)):
        out = F.when(h < cuts[k], k).otherwise(out)
    return out


def bootstrap_index_ci(df: DataFrame, key: str, id_col: str, value: str, weight: str, reps: int, seed: int) -> DataFrame:
    """95 % interval of sum(value) / sum(weight) for each key, over Poisson bootstrap replicates.

    Each row counts a Poisson(1) number of times in each replicate, by a hash of its id: no row moves, and all replicates are summed
    in one pass before the shuffle.
    """
    each = df.select(key, id_col, value, weight, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col(id_col).cast("string"))), 1, 8)
    sums = each.withColumn("_h", digits).withColumn("_k", _poisson(F.col("_h"))).where("_k > 0").groupBy(key, "rep").agg(F.sum(F.col(value) * F.col("_k")).alias("v"), F.sum(F.col(weight) * F.col("_k")).alias("w"))
    each = sums.select(key, "rep", F.when(F.col("w") > 0, F.col("v") / F.col("w")).otherwise(0.0).alias("s"))
    w = Window.partitionBy(key)  # reps rows
    each = each.withColumns({"r": F.row_number().over(w.orderBy("s", "rep")) - 1, "m": F.count("*").over(w)})
    return each.groupBy(key).agg(F.max(F.when(F.col("r") == F.floor(F.col("m") * 0.025), F.col("s"))).alias("ci_low"), F.max(F.when(F.col("r") == F.floor(F.col("m") * 0.975), F.col("s"))).alias("ci_high"))


def permuted_cells(x: np.ndarray, y: np.ndarray, n: np.ndarray, reps: int, seed: int) -> float:
    """Share of permutations of y over the rows whose slope on x is at least as large as the one seen.

    The rows come as counts n of equal (x, y). Dealing a value's rows at random to the places that are left is a multivariate
    hypergeometric draw, so a permutation costs as many steps as there are distinct values, not rows.
    """
    xs, ys = np.unique(x), np.unique(y)
    places = np.bincount(np.searchsorted(xs, x), n, len(xs)).astype(np.int64)
    of_value = np.bincount(np.searchsorted(ys, y), n, len(ys)).astype(np.int64)
    centred = xs - (xs * places).sum() / places.sum()
    seen = abs((n * (x - (xs * places).sum() / places.sum()) * y).sum())
    rng, extreme = np.random.default_rng(seed), 0
    for _ in range(reps):
        left, total = places.copy(), 0.0
        for v, m in zip(ys[:-1], of_value[:-1], strict=True):
            got = rng.multivariate_hypergeometric(left, m, method="marginals")
            total += v * (centred * got).sum()
            left -= got
        total += ys[-1] * (centred * left).sum()
        extreme += abs(total) >= seen - 1e-9
    return extreme / reps


def primary_balance(df: DataFrame, key: str, value: str, reps: int = 500, seed: int = 20260604, least: int = 20) -> DataFrame:
    """df: key, year, authority_level, value, usable rows only. For each key: rows, primary rows and share, and the permutation p of the primary rows' trend.

    p is null under least primary rows, and 1 where the slope is 0. value should take few distinct values: a key's task holds
    its (year, value) cells, not its rows.
    """
    df = cut_lineage(df.where("year is not null").select(key, "year", F.lower(F.trim(F.coalesce("authority_level", F.lit("missing")))).alias("level"), F.col(value).cast("double").alias("v")))
    one = df.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col("level") == "primary").alias("primary_rows")).withColumn("primary_share", F.col("primary_rows") / F.col("rows"))
    cells = df.where("level = 'primary' and v is not null").groupBy(key, "year", "v").agg(F.count("*").alias("n"))

    def tested(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, n = (pdf[c].to_numpy(float) for c in ("year", "v", "n"))
        mean = (x * n).sum() / n.sum()
        flat = abs((n * (x - mean) * y).sum()) < 1e-12 * max(1.0, (n * (x - mean) ** 2).sum())
        return pd.DataFrame({"k": [str(pdf[key].iloc[0])], "p_value": [1.0 if flat else permuted_cells(x, y, n.astype(np.int64), reps, seed)]})

    cells = cells.join(one.where(F.col("primary_rows") >= least).select(key), key, "left_semi")

    p = cells.groupBy(key).applyInPandas(tested, "k string, p_value double")
    return one.join(p, F.col(key).cast("string") == F.col("k"), "left").drop("k")
