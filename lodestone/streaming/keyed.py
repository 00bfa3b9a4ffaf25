"""Streams with keyed state (transformWithState): keys once, and changes between an entity's captures.

State is kept by Spark in RocksDB, on disk and in the checkpoint, not in memory: a stream of these starts within
disk_state, which sets spark.sql.streaming.stateStore.providerClass.
"""
from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Spark loads a processor in a process of its own on the driver, which need not find this package: it is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextlib.contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, was)


class _First(StatefulProcessor):
    """Emits a key's first row and remembers the key, for ttl milliseconds after it last came or for good."""

    def __init__(self, order: list[str], ttl: int | None):
        self.order, self.ttl = order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("n", T.LongType())]), self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.get() if self.seen.exists() else None
        first, n = None, 0
        for part in rows:
            n += len(part)
            if known is None:
                part = part if first is None else pd.concat([first, part])
                first = part.sort_values(self.order, kind="stable").head(1)
        self.seen.update(((known[0] if known else 0) + n,))
        if known is None and first is not None:
            yield first

    def close(self) -> None:
        pass


def _first_rows(table: pa.Table, key: list[str], order: list[str]) -> pa.Table:
    table = table.take(pc.sort_indices(table, sort_keys=[(o, "ascending") for o in order]))
    numbered = table.select(key).append_column("_n", pa.array(np.arange(len(table))))
    return table.take(numbered.group_by(key).aggregate([("_n", "min")])["_n_min"])


def first_of_key(stream: DataFrame, key: list[str], order: list[str], ttl: int | None = None, buckets: int = 4096) -> DataFrame:
    """Each key's first row, once over the whole life of the stream, however late the key comes again.

    Of rows that arrive together the first by order counts: it is found for buckets of keys at once, then Spark's own
    deduplication keeps the keys. ttl: milliseconds after its last row when a key may be forgotten; such keys have a number each
    in a processor's state. Rows with a null key are a key of their own.
    """
    if ttl:
        return stream.groupBy(*key).transformWithStateInPandas(_First(order, ttl), outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _first_rows(pa.Table.from_batches([batch]), key, order).to_batches()

    thinned = stream.mapInArrow(thin, stream.schema)
    first = thinned.groupBy(F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("_bucket")).applyInArrow(lambda table: _first_rows(table, key, order), stream.schema)
    return first.dropDuplicates(key)


class _Changes(StatefulProcessor):
    """Holds captures until the watermark has passed them, then compares each with its entity's one before.

    A key is a bucket of entities. Captures are held as Arrow tables of many rows each; the last one of each entity has an entry of its own.
    """

    def __init__(self, counts: list[str], columns: list[str]):
        self.counts, self.columns = counts, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = [T.StructField("us", T.LongType()), T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in self.counts]]
        self.held = handle.getListState("held", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.last = handle.getMapState("last", T.StructType([T.StructField("entity", T.StringType())]), T.StructType(row))

    def pack(self, rows: pd.DataFrame) -> tuple[bytes]:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(rows, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return (sink.getvalue().to_pybytes(),)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, least = [], None
        for part in rows:
            if len(part):
                new.append(self.pack(part[["entity", "us", "id", "text", *self.counts]]))
                least = int(part.us.min()) if least is None else min(least, int(part.us.min()))
        if new:
            self.held.appendList(new)
            self.handle.registerTimer(least // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        chunks = [pa.ipc.open_stream(r[0]).read_pandas() for r in self.held.get()] if self.held.exists() else []
        held = pd.concat(chunks, ignore_index=True) if chunks else None
        if held is None or not (held.us < until).any():
            return
        due, rest = held[held.us < until], held[held.us >= until]
        if len(rest):
            self.held.put([self.pack(rest)])
            self.handle.registerTimer(int(rest.us.min()) // 1000 + 1)
        else:
            self.held.clear()
        at = ["entity", "us", "id"]
        due = due.sort_values([*at, "text", *self.counts] if due.duplicated(at).any() else at, kind="stable").drop_duplicates(at)
        known = [(e, *tuple(r)) for e in due.entity.unique().tolist() if (r := self.last.getValue((e,))) is not None]
        if known:
            known = pd.DataFrame(known, columns=due.columns).astype(due.dtypes.to_dict())
            both = due.merge(known[at], on="entity", how="left", suffixes=("", "_last"))
            late = (both.us < both.us_last) | (both.us == both.us_last) & (both.id <= both.id_last)
            due = pd.concat([known, due[~late.to_numpy()]], ignore_index=True).sort_values(at, kind="stable")
        before = due.shift(1)
        same = (due.entity == before.entity).to_numpy()
        end = due[(due.entity != due.entity.shift(-1)).to_numpy()]
        for r in end.itertuples(index=False):
            self.last.updateValue((r[0],), (int(r[1]), int(r[2]), r[3], *map(int, r[4:])))
        due, before = due[same], before[same]
        if len(due):
            out = [np.full(len(due), key[0], np.int32), due.entity, due.us, due.id, before.us.astype("int64"), due.text != before.text, *[due[c] - before[c].astype("int64") for c in self.counts]]
            yield pd.DataFrame(dict(zip(self.columns, out, strict=True)))

    def close(self) -> None:
        pass


def changes(stream: DataFrame, entity: str, ts: str, order: str, text: str, counts: dict[str, F.Column] | None = None, late: str = "1 hour", buckets: int = 4096) -> DataFrame:
    """Each capture against the entity's one before, in event time: whether its text changed, and by how much each count did.

    A capture is compared when the watermark has passed it, so the order of arrival does not matter within `late`; later ones
    are dropped. order: a whole number that orders captures of the same time. Null texts are empty and count 0. Entities are
    dealt to buckets, so that state is read and written for many captures at once.
    """
    counts = counts or {}
    kind = stream.schema[entity].dataType
    # entities are strings in the state; those of a null have a bucket of their own
    rows = stream.withWatermark(ts, late).select(
        F.when(F.col(entity).isNull(), -1).otherwise(F.pmod(F.xxhash64(entity), F.lit(buckets))).cast("int").alias("bucket"), F.coalesce(F.col(entity).cast("string"), F.lit("")).alias("entity"), ts,
        F.unix_micros(ts).alias("us"), F.col(order).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"), *[F.coalesce(c.cast("long"), F.lit(0)).alias(f"n_{n}") for n, c in counts.items()],
    )
    field = lambda name, kind: T.StructField(name, kind)
    out = T.StructType([field("bucket", T.IntegerType()), field("entity", T.StringType()), field("us", T.LongType()), field("id", T.LongType()), field("previous", T.LongType()), field("text_changed", T.BooleanType()), *[field(f"delta_{n}", T.LongType()) for n in counts]])
    found = rows.groupBy("bucket").transformWithStateInPandas(_Changes([f"n_{n}" for n in counts], out.names), outputStructType=out, outputMode="Append", timeMode="EventTime")
    named = F.when(F.col("bucket") >= 0, F.col("entity")).cast(kind).alias(entity)
    return found.select(named, F.timestamp_micros("us").alias(ts), F.col("id").cast(stream.schema[order].dataType).alias(order), F.timestamp_micros("previous").alias("previous"), "text_changed", *[f"delta_{n}" for n in counts])
