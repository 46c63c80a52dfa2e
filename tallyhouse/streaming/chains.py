"""Version chains in a stream: of each external id the newest hash and version are its state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyhouse.operators.incremental import insert_versions
from tallyhouse.sources.store import Store

CHANGES = "source string, external_id string, content_hash string, arrival long, version long, closes string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Chain(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "content_hash string, version long")
        self.known = handle.getMapState("known", "content_hash string", "version long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = lambda x: x.groupby("content_hash", as_index=False)["arrival"].min()
        frame = first(pd.concat([first(part) for part in rows])).sort_values(["arrival", "content_hash"])  # the state is asked once a hash, not once a row
        last, version = self.newest.get() if self.newest.exists() else (None, 0)
        out = []
        for content_hash, arrival in zip(frame["content_hash"], frame["arrival"], strict=True):
            if not self.known.containsKey((content_hash,)):
                out.append((*key, content_hash, int(arrival), version + 1, last))
                last, version = content_hash, version + 1
                self.known.updateValue((content_hash,), (version,))
        if out:
            self.newest.update((last, version))
        yield pd.DataFrame(out, columns=["source", "external_id", "content_hash", "arrival", "version", "closes"])

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    """A stream of what a stream of bookings (source, external_id, content_hash, arrival) opens and closes: a row for each new hash of an external id, with its version and the hash that it supersedes.

    The state is the newest hash and version of each external id and the hashes it has had, kept in RocksDB; a hash that
    comes again changes nothing. Within a batch rows count in the order (arrival, content_hash), and batches in turn.
    Rows without an external id or a hash are no chain and are left out.
    """
    named = stream.select("source", "external_id", "content_hash", F.col("arrival").cast("long").alias("arrival")).where("external_id is not null and content_hash is not null")
    return named.groupBy("source", "external_id").transformWithStateInPandas(_Chain(), CHANGES, "append", "None")


def chained(stream: DataFrame, path: str) -> DataFrame:
    """All versions of a stream of bookings, as ``changes`` told them below ``path``: source, external_id, content_hash, arrival, version, superseded_by."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        query = changes(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/changes").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    told = spark.read.schema(T.StructType.fromDDL(CHANGES)).parquet(f"{path}/changes")
    closed = told.where("closes is not null").select(F.col("source").alias("_source"), "external_id", F.col("closes").alias("content_hash"), F.col("content_hash").alias("superseded_by"))
    opened = told.drop("closes").alias("o")
    same = (F.col("o.external_id") == F.col("c.external_id")) & (F.col("o.content_hash") == F.col("c.content_hash")) & F.col("o.source").eqNullSafe(F.col("c._source"))
    return opened.join(closed.alias("c"), same, "left").select("o.*", "c.superseded_by")


def kept(stream: DataFrame, store: Store) -> None:
    """Puts a stream of bookings into ``store``, batch by batch: a batch reads and writes the buckets of its own keys, and one that runs twice counts once."""

    def put(rows: DataFrame, n: int) -> None:
        insert_versions(store, rows, f"batch {n}")

    query = stream.writeStream.option("checkpointLocation", f"{store.path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
