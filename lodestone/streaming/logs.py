"""Structured Streaming forms of the log jobs; each is a plain function of a (streaming) DataFrame."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import count_terms
from ..sources.tables import append_alerts


def windowed_progress(log: DataFrame, ts: str = "ts", late: str = "1 hour", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """log: ok, result_count. Attempts, failures and yield in each event-time window; rows later than late are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = log.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("attempts"), F.sum(F.when(~F.col("ok"), 1).otherwise(0)).alias("failures"), F.sum("result_count").alias("results"))
    return out.select(F.col("w.start").alias("window_start"), "attempts", "failures", (F.col("failures") / F.col("attempts")).alias("failure_ratio"), "results")


def alerts_once(alerts: DataFrame, path: str, checkpoint: str, key: str = "alert_id") -> None:
    """Appends each alert to the table at path once, however often and late it comes again.

    What was sent is known from the table itself, so no state grows in memory; a batch that runs again appends nothing.
    """
    def append(batch: DataFrame, _: int) -> None:
        append_alerts(batch.select(key), path, key)

    alerts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def score_arriving(rows: DataFrame, text: str, terms: list[str], key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Counts lexicon terms in rows as they arrive, each key once within the watermark."""
    n, matched = count_terms(F.col(text), terms)
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key).withColumns({"term_count": n, "matched_terms": matched})


def sessions(log: DataFrame, entity: str, ts: str = "ts", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs of an entity's rows with no gap longer than gap."""
    out = log.withWatermark(ts, late).groupBy(entity, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("rows"))
    return out.select(entity, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "rows")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, into a Parquet table."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
